"""Subjects: rules, evidence, decisions; held-out accuracy on made-up documents."""

import random
from collections import Counter

from lodesift.llm import subjects

WORDS = {"law": ["court", "judge", "appeal", "notary seal", "bailiff"], "music": ["violin", "choir", "drummer", "tour bus", "encore"], "sport": ["referee", "striker", "relay team", "goalkeeper", "sprint"]}
FRAMES = ["The {} handler reads a value and hands it to a query.", "Old {} data kept the wrong page for 12 days.", "load_{}_7(value) returns nothing here", "Users saw a blank {} list."]


def made_up(n, seed):
    r = random.Random(seed)
    docs, truth = [], []
    for i in range(n):
        some = r.sample(sorted(WORDS), 2 if r.random() < 0.1 else 1)
        text = []
        for _ in range(r.randint(6, 12)):
            w = r.choice(WORDS[r.choice(some)])
            f = r.choice(FRAMES)
            text.append(f.format(w.replace(" ", "_") if "load_" in f else w))
        if r.random() < 0.3:
            text.append("A sister project on the " + r.choice(WORDS[r.choice(sorted(WORDS))]) + " is not affected.")
        docs.append((i, "\n".join(text)))
        truth.append((i, some))
    return docs, truth


def test_words():
    assert subjects.words("loadTourBus_7 ABCDef éa") == ["load", "tour", "bus", "abc", "def", "éa"]
    assert subjects.sentences("A b. C!\n\n12\nD") == [["a", "b"], ["c"], ["d"]]


def test_mined_rules_and_accuracy(spark):
    docs, truth = made_up(400, 1)
    labels = [(i, s) for i, some in truth for s in some]
    areas = spark.createDataFrame([(s, "d") for s in WORDS], "subject string, description string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = subjects.fit(df, spark.createDataFrame([*labels, (1, "unknown"), (None, "law")], "doc_id long, subject string"), areas)
    found = {w for w in model.rules}
    assert {"court", "violin", "referee"} <= found and "handler" not in found and "users" not in found
    test, want = made_up(300, 2)
    got = {}
    for r in subjects.assign(spark.createDataFrame(test, "doc_id long, text string"), model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    hit = sum(len(got.get(i, set()) & set(s)) for i, s in want)
    assert hit / sum(len(s) for _, s in want) > 0.95 and hit / sum(len(s) for s in got.values()) > 0.95
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "nothing here", 1), (5, "court", 1), (6, "The judge. " * 20_000, 1)], "doc_id long, text string, subject int")
    assert [(r.doc_id, r.subject) for r in subjects.assign(odd, model).collect()] == [(6, "law")]
    comp = {r.subject: (r.n_docs, round(r.share, 3)) for r in subjects.composition(subjects.assign(odd, model), odd, areas).collect()}
    assert comp == {"law": (1, 0.167), "music": (0, 0.0), "sport": (0, 0.0)}


def test_rules_are_pruned(spark):
    docs = [(i, ["law"], "court case one.") for i in range(10)] + [(10 + i, ["music"], "violin case two.") for i in range(10)]
    rules = subjects.mine(spark.createDataFrame(docs, "doc_id long, subjects array<string>, text string"))
    bodies = {(b, s) for b, s, _, _ in rules}
    assert (frozenset({"court"}), "law") in bodies and not any(len(b) > 1 and "court" in b for b, _ in bodies)
    assert not any("case" in b for b, _ in bodies)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "court")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    areas = spark.createDataFrame([("law", "d")], "subject string, description string")
    assert subjects.assign(df, subjects.fit(df, none, areas)).count() == 0


def test_decide():
    w = Counter({"a": 10.0, "b": 5.0, "c": 4.0})
    assert subjects.decide(w, Counter(a=4, b=2, c=2), 0.45, (2, 2)) == ["a", "b"]
    assert subjects.decide(w, Counter(a=4, b=2, c=2), 0.4, (2, 2)) == ["a", "b", "c"]
    assert subjects.decide(w, Counter(a=1, b=2, c=2), 0.9, (2, 2)) == ["b"]
    assert subjects.decide(w, Counter(a=1, b=2, c=1), 0.4, (1, 2)) == ["a", "b"]
    assert subjects.decide(w, Counter(a=1, b=1, c=1), 0.4, (2, 2)) == [] == subjects.decide(Counter(), Counter(), 0.4, (1, 1))
    assert subjects.decide(Counter({"b": 3.0, "a": 3.0}), Counter(a=2, b=2), 0.4, (2, 2)) == ["a", "b"]


def test_calibration():
    seen = [(Counter({"a": 9.0, "b": 1.0}), Counter(a=3, b=1), {"a"}), (Counter({"a": 9.0, "b": 8.0}), Counter(a=3, b=3), {"a", "b"}), (Counter({"b": 3.0}), Counter(b=1), {"b"})]
    share, least = subjects.calibrate(seen)
    assert least == (1, 3) and share == 0.85 and all(set(subjects.decide(w, c, share, least)) == s for w, c, s in seen)
    assert subjects.calibrate([]) == (0.4, (2, 2))


def test_every_word_of_long_sentences_is_mined(spark):
    """Forty words in one sentence: each makes a rule, in runs whose itemsets stay bounded."""
    names = {s: [f"{s}{chr(97 + i // 20)}{chr(97 + i % 20)}x" for i in range(40)] for s in ("law", "music")}
    docs = [(i, [s], " ".join(names[s]) + ".") for i, s in enumerate(["law", "music"] * 6)]
    rules = subjects.mine(spark.createDataFrame(docs, "doc_id long, subjects array<string>, text string"))
    assert {w for b, s, _, _ in rules for w in b if len(b) == 1} == {w for ws in names.values() for w in ws}
    assert len(subjects.mine(spark.createDataFrame(docs, "doc_id long, subjects array<string>, text string"), most_rules=10)) == 0
