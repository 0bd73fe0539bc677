"""Subject areas of documents by class-association rules.

Sentences of hand-labelled documents, with their subject as one more item, are mined for frequent itemsets by
parallel FP-growth; itemsets with a subject give rules ``words -> subject``. Rules that a shorter one
covers at the same confidence are pruned. Every document is scored by the rules that match
its sentences: neighbouring matches are one mention, weighted by the log odds of its surest rule. A
document has the subjects with mentions enough whose evidence comes near enough to the strongest; how many and how near is calibrated on
labelled documents that no rule was mined from.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodesift.session import cut, ship, spread

#: Labelled documents the rules are mined from, at most; those with the lowest hash of their id.
MAX_LABELLED = 20_000
#: Labelled sentences an itemset must be in.
LEAST_COUNT = 4
#: Confidence from which a word takes part in the mining, and a rule is kept.
WORD_CONFIDENCE, RULE_CONFIDENCE = 0.5, 0.7
#: Words of a rule, at most. Rules are itemsets of a run of words, and the words of a longer sentence are mined in runs of ``RUN``, so that
#: the itemsets of a sentence that occurs often stay bounded; every word of every sentence is in one run.
MOST_WORDS, RUN = 3, 12
#: Rules that come to the driver, at most; where there are more, those with too little support for the bound are left out (``mine``).
MAX_RULES = 200_000
#: One in so many labelled documents is kept from the mining, for the calibration.
CALIBRATION = 4
#: Log odds of a rule that has no counterexample, at most.
TOP_WEIGHT = 3.0

# A word: capitals, but for the last where small letters follow, or small letters with a capital before them at most.
_WORD = re.compile(r"[A-Z]+(?![^\W\d_A-Z])|[A-Z]?[^\W\d_A-Z]+")
_SENTENCE = re.compile(r"\n+|(?<=[.!?;])\s+")


@dataclass(frozen=True)
class Model:
    """``rules``: by their first word, (further words, subject, weight); ``share``: of the top evidence a further subject needs; ``least``: mentions the first and a further subject need."""

    rules: dict[str, tuple[tuple[frozenset[str], str, float], ...]]
    share: float
    least: tuple[int, int]


def words(text: str) -> list[str]:
    """The words of a text in lower case; snake and camel case are split."""
    return list(map(str.lower, _WORD.findall(text)))


def sentences(text: str) -> list[list[str]]:
    """The words of each line or sentence that has any."""
    return [list(map(str.lower, w)) for s in _SENTENCE.split(text) if (w := _WORD.findall(s))]


def _sentence_rows(df: DataFrame) -> DataFrame:
    """``doc_id, subject, words`` per distinct sentence of a document (``doc_id, subject, text``); words once each, in order."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, subjects, out = [], [], []
            for i, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for w in {tuple(dict.fromkeys(x)) for x in sentences(t or "")}:
                    ids.append(i)
                    subjects.append(s)
                    out.append(list(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(subjects, pa.string()), pa.array(out, pa.list_(pa.string()))], ["doc_id", "subject", "words"])

    return df.select("doc_id", "subject", "text").mapInArrow(run, "doc_id long, subject string, words array<string>")


def labelled(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, text, subjects`` of at most ``most`` labelled documents; labels outside ``areas`` don't count."""
    known = labels.join(areas.select("subject").distinct(), "subject", "left_semi").where("doc_id IS NOT NULL")
    chosen = known.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return chosen.join(documents.select("doc_id", "text").where(F.col("text") != ""), "doc_id")


def mine(sample: DataFrame, least: int = LEAST_COUNT, most_rules: int = MAX_RULES) -> list[tuple[frozenset[str], str, float, int]]:
    """The pruned rules ``(words, subject, confidence, count)`` of the documents with one subject.

    Confidences are formed before anything comes to the driver. If more than ``most_rules`` rules are sure enough, ``least``
    is doubled until they aren't.
    """
    from pyspark.ml.fpm import FPGrowth

    single = sample.where(F.size("subjects") == 1).select("doc_id", F.element_at("subjects", 1).alias("subject"), "text")
    rows = cut(_sentence_rows(single).withColumn("row", F.monotonically_increasing_id()))
    # words whose documents mostly have one subject, or may in company; the others can't be part of a rule that is kept
    by_word = rows.select("doc_id", "subject", F.explode("words").alias("w")).distinct().groupBy("w", "subject").count()
    kept = by_word.groupBy("w").agg(F.max("count").alias("top"), F.sum("count").alias("n")).where((F.col("n") >= least) & (F.col("top") >= WORD_CONFIDENCE * F.col("n"))).select("w")
    words_of = rows.select("row", "subject", F.posexplode("words").alias("at", "w")).join(kept, "w")
    place = F.row_number().over(Window.partitionBy("row").orderBy("at")) - 1
    runs = words_of.withColumn("run", F.floor(place / RUN)).groupBy("row", "run", "subject").agg(F.collect_set("w").alias("ws"))
    baskets = cut(runs.select(F.concat(F.array(F.concat(F.lit("="), "subject")), "ws").alias("items")))
    n = baskets.count()
    if not n:
        return []
    found = FPGrowth(itemsCol="items", minSupport=max(least, 1) / n, minConfidence=0.0).fit(baskets).freqItemsets.where(F.size("items") <= MOST_WORDS + 1)
    marked = found.select(F.array_sort(F.filter("items", lambda x: ~x.startswith("="))).alias("body"), F.get(F.filter("items", lambda x: x.startswith("=")), F.lit(0)).alias("subject"), "freq")
    bodies = marked.where(F.col("subject").isNull()).select("body", F.col("freq").alias("all"))
    sure = cut(marked.where(F.col("subject").isNotNull() & (F.size("body") > 0)).join(bodies, "body").where((F.col("freq") >= RULE_CONFIDENCE * F.col("all")) & (F.col("freq") >= least)))
    while sure.where(F.col("freq") >= least).count() > most_rules:
        least *= 2
    rules = [(frozenset(r["body"]), r["subject"][1:], r["freq"] / r["all"], r["freq"]) for r in sure.where(F.col("freq") >= least).collect()]
    best = {(body, s): c for body, s, c, _ in rules}
    return [
        (body, s, c, k)
        for body, s, c, k in rules
        if not any(best.get((body - {w}, s), 0.0) >= c - 0.02 for w in body)
        and (len(body) < 3 or not any(best.get((frozenset((w,)), s), 0.0) >= c - 0.02 for w in body))
    ]


def compiled(rules: list[tuple[frozenset[str], str, float, int]], share: float, least: tuple[int, int]) -> Model:
    by_first: dict[str, list[tuple[frozenset[str], str, float]]] = defaultdict(list)
    for body, subject, confidence, k in rules:
        smooth = (confidence * k + 0.5) / (k + 1.5)
        first = min(body)
        by_first[first].append((body - {first}, subject, min(TOP_WEIGHT, math.log(smooth / (1 - smooth)))))
    return Model({w: tuple(sorted(r, key=lambda x: (-len(x[0]), x[1]))) for w, r in by_first.items()}, share, least)


def evidence(text: str | None, model: Model) -> tuple[Counter, Counter]:
    """Weight and number of mentions by subject."""
    weight: Counter = Counter()
    count: Counter = Counter()
    rules, known = model.rules, model.rules.keys()
    for ws in sentences(text or ""):
        if known.isdisjoint(ws):
            continue
        inside = set(ws)
        hit: dict[str, tuple[str, float]] = {}
        for w in dict.fromkeys(ws):
            if w not in rules:
                continue
            for rest, subject, x in rules[w]:
                if rest <= inside:
                    for y in (w, *rest):
                        if x > hit.get(y, ("", 0.0))[1]:
                            hit[y] = (subject, x)
        if not hit:
            continue
        last, top = "", 0.0
        for w in (*ws, ""):
            subject, x = hit.get(w, ("", 0.0))
            if subject != last:
                if last:
                    weight[last] += top
                    count[last] += 1
                last, top = subject, x
            else:
                top = max(top, x)
    return weight, count


def decide(weight: Counter, count: Counter, share: float, least: tuple[int, int]) -> list[str]:
    """The subjects of a document, the strongest first; ties by name.

    The first is the strongest with ``least[0]`` mentions; others need ``least[1]`` mentions and ``share`` of its evidence.
    """
    order = sorted((s for s in weight if count[s] >= min(least)), key=lambda s: (-weight[s], s))
    first = next((s for s in order if count[s] >= least[0]), None)
    return [] if first is None else [first, *(s for s in order if s != first and count[s] >= least[1] and weight[s] >= share * weight[first])]


def calibrate(seen: list[tuple[Counter, Counter, set[str]]], slack: float = 0.001) -> tuple[float, tuple[int, int]]:
    """The share and least mentions that give the most right (document, subject) pairs by F1, from evidence and labels.

    Of all that come within ``slack`` of the best, the strictest: the most mentions, then the greatest share. Without documents it is 0.4 and 2 mentions.
    """
    if not seen:
        return 0.4, (2, 2)
    tried = []
    for least in product((1, 2, 3), (1, 2, 3, 4)):
        for i in range(4, 18):
            hit = given = wanted = 0
            for weight, count, s in seen:
                d = set(decide(weight, count, i / 20, least))
                hit, given, wanted = hit + len(d & s), given + len(d), wanted + len(s)
            tried.append((2 * hit / max(1, given + wanted), least, i / 20))
    best = max(f1 for f1, _, _ in tried)
    _, least, share = max((x for x in tried if x[0] >= best - slack), key=lambda x: x[1:])
    return share, least


def _evidence_of(sample: DataFrame, model: Model) -> list[tuple[Counter, Counter, set[str]]]:
    """Evidence and labels of the sample's documents; texts stay on the executors."""
    spark = sample.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [evidence(t, shared.value) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([list(w) for w, _ in found], pa.list_(pa.string())), pa.array([[float(x) for x in w.values()] for w, _ in found], pa.list_(pa.float64())), pa.array([[c[k] for k in w] for w, c in found], pa.list_(pa.int32()))],
                ["subjects", "names", "weights", "counts"],
            )

    rows = sample.select("subjects", "text").mapInArrow(run, "subjects array<string>, names array<string>, weights array<double>, counts array<int>").collect()
    return [(Counter(dict(zip(r["names"], r["weights"], strict=True))), Counter(dict(zip(r["names"], r["counts"], strict=True))), set(r["subjects"])) for r in rows]


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Mines the rules and calibrates the decision; without labels the model gives no subject.

    The decision is calibrated on documents set aside, with rules mined from the others; the rules of the model are then mined from all.
    """
    sample = cut(labelled(documents, labels, areas, most))
    aside = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(CALIBRATION)) == 0
    decision = calibrate(_evidence_of(sample.where(aside), compiled(mine(sample.where(~aside)), 0.4, (2, 2))))
    return compiled(mine(sample), *decision)


def assign(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, subject, weight, mentions`` of every document of ``documents`` (``doc_id, text``); none for texts about no subject.

    Null, empty and blank texts have no subject; repeated rows come out each; whole texts are read.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = []
            for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                weight, count = evidence(t, m)
                rows += [(i, s, float(weight[s]), count[s]) for s in decide(weight, count, m.share, m.least)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int32()), strict=True)], ["doc_id", "subject", "weight", "mentions"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, subject string, weight double, mentions int")


def composition(assigned: DataFrame, documents: DataFrame, areas: DataFrame) -> DataFrame:
    """Per subject: documents and the share of all documents; a document of two subjects counts half in each share."""
    total = documents.select(F.count(F.lit(1)).alias("total"))
    per_doc = assigned.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    got = assigned.join(per_doc, "doc_id").groupBy("subject").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum(1 / F.col("k")).alias("weight"))
    return areas.select("subject").distinct().join(got, "subject", "left").join(F.broadcast(total)).select("subject", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), (F.coalesce("weight", F.lit(0.0)) / F.greatest("total", F.lit(1))).alias("share"))
