"""Taint between the functions of a file: arguments that reach a sink in the function they are passed to.

Every function is folded once with its parameters as sources, which tells the parameters that reach a sink and those that are passed on to another
function. Passing on is followed over at most ``MAX_DEPTH`` calls. Then each call with an argument that carries foreign data in its caller is a
finding. As edges are between functions of one file, all of it is one pass over files without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.operators import taint
from lodesift.operators.callgraph import MAX_DEPTH, SINKS
from lodesift.operators.catalogs import CORE, Catalog, Source
from lodesift.session import ship, spread

FINDING = "caller string, callee string, argument int, line_number int, sink_category string, sink_line int, depth int, matched_text string"
#: Confidence of a flow between functions.
SCORE = 0.8


@lru_cache(maxsize=1 << 12)
def _call(name: str) -> re.Pattern[str]:
    return re.compile(rf"(?<![\w$]){re.escape(name)}\s*\(")


def analyse(text: str, language: str, catalog: Catalog = CORE) -> list[tuple[str, str, int, int, str, int, int, str]]:
    """The findings of a file: caller, callee, argument, line, category, the sink's line, calls between, text."""
    scopes = [s for s in taint.scopes(text, language) if s.name != "__top_level__"]
    named = {s.name: s for s in reversed(scopes)}  # of one name the first counts
    if not named:
        return []
    reached: dict[tuple[str, int], dict[str, tuple[int, int]]] = {}  # parameter -> category -> (line of the sink, calls between)
    passed: list[tuple[str, int, str, int, frozenset[str]]] = []  # caller, its parameter, callee, argument, what is clean
    foreign: list[tuple[str, str, int, int, str, frozenset[str]]] = []  # caller, callee, argument, line, text, what is clean

    def fold(scope: taint.Scope, params: list[tuple[str, ...]]) -> None:
        seeds = {n: Source(f"param:{i}", "param", language, "") for i, names in enumerate(params) for n in names}

        def calls(k: int, no: int, state: dict) -> None:
            line = scope.lines[k][1]
            if "(" not in line or no == scope.start:
                return
            for name in named:
                m = _call(name).search(line) if name in line else None
                if m is None or name == scope.name:
                    continue
                for i, arg in enumerate(taint.arguments(taint._full_call(scope.lines, k, m.end() - 1), m.end() - 1)):
                    direct = next((x for x, p in taint._compiled(language, catalog)[0] if p.search(arg)), None)
                    if direct is not None:
                        foreign.append((scope.name, name, i, no, arg, frozenset()))
                        continue
                    carriers = sorted(((v, n) for n, v in state.items() if taint._refers(n).search(arg)), key=lambda x: (x[0].source.category == "param", -x[0].confidence, x[1]))
                    if carriers:
                        v = carriers[0][0]
                        if v.source.category == "param":
                            passed.append((scope.name, int(v.source.id[6:]), name, i, v.clean))
                        else:
                            foreign.append((scope.name, name, i, no, arg, v.clean))

        for src, _, sink, no, _, _ in taint.track(scope, language, catalog, seeds, calls):
            if src.category == "param" and named.get(scope.name) is scope:
                reached.setdefault((scope.name, int(src.id[6:])), {}).setdefault(sink.category, (no, 1))

    for scope in scopes:
        head = taint._full_call(scope.lines, 0, 0)
        fold(scope, taint.parameters(head, language))
    for depth in range(2, MAX_DEPTH + 1):
        grown = False
        for caller, j, callee, i, clean in passed:
            for category, (no, d) in list(reached.get((callee, i), {}).items()):
                if d == depth - 1 and category not in clean and category not in reached.get((caller, j), {}):
                    reached.setdefault((caller, j), {})[category] = (no, depth)
                    grown = True
        if not grown:
            break
    out = {(caller, callee, i, no, category, at, d, arg[:120]) for caller, callee, i, no, arg, clean in foreign for category, (at, d) in reached.get((callee, i), {}).items() if category not in clean}
    return sorted(out)


def flows(files: DataFrame, key: str, catalog: Catalog = CORE) -> DataFrame:
    """``key`` and ``FINDING`` of every file (``key, lang, content``): each argument with foreign data that reaches a sink of a category in the called function, or in one that it calls.

    Files without content or language have none; a sanitizer of the category on the way cancels; of functions of one name the first counts.
    """
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in FINDING.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *x) for k, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True) if taint._compiled(lang, catalog)[1] for x in analyse(text, lang, catalog)]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]], [key, *names])

    return spread(files.where(F.col("content").isNotNull() & F.col("lang").isNotNull()).select(key, "lang", "content")).mapInArrow(run, f"{key} {kind}, {FINDING}")


def as_findings(the_flows: DataFrame) -> DataFrame:
    """Flows between functions as findings, rated High at least."""
    cwe = F.create_map(*[F.lit(x) for k, (c, _, _) in SINKS.items() for x in (k, c)])
    rating = F.create_map(*[F.lit(x) for k, (_, _, v) in SINKS.items() for x in (k, v)])
    return the_flows.withColumns(
        {
            "rule_id": F.concat(F.lit("INTERPROC-"), F.upper("sink_category")),
            "severity": F.greatest(F.lit(3), F.coalesce(F.try_element_at(rating, F.col("sink_category")), F.lit(3))),
            "title": F.concat(F.lit("Foreign data flows through "), "callee", F.lit("() to "), "sink_category"),
            "cwe_id": F.coalesce(F.try_element_at(cwe, F.col("sink_category")), F.lit("")),
            "confidence": F.lit("high"),
            "confidence_score": F.lit(SCORE),
            "tags": F.array(F.lit("interprocedural"), F.lit("taint-analysis"), F.lit("cross-function"), F.col("sink_category")),
        }
    )


def suppressed_sinks(signatures: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """``signatures`` (``key, id, sink_calls``) with the sinks on suppressed lines (``suppress.covered``) moved to ``suppressed_sinks``."""
    per_file = ranges.groupBy(key).agg(F.collect_list(F.struct("first", "last")).alias("__r"))
    joined = signatures.join(per_file, key, "left")
    none = F.array().cast(signatures.schema["sink_calls"].dataType)
    off = lambda c: F.exists(F.coalesce("__r", F.array().cast("array<struct<first:int,last:int>>")), lambda x: c["line"].between(x["first"], x["last"]))
    return joined.withColumns({"suppressed_sinks": F.coalesce(F.filter("sink_calls", off), none), "sink_calls": F.coalesce(F.filter("sink_calls", lambda c: ~off(c)), none)}).drop("__r")
