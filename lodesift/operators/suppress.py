"""Inline suppressions: comments that turn findings off for a line or a block of lines.

``<keyword>:ignore targets [-- reason]`` covers its own line and the next line of code;
``<keyword>:ignore-start targets`` and ``<keyword>:ignore-end`` cover the lines between, and nest; an open block lasts to the
end of the file. A target is a rule id, a category or ``all``.

Directives are found in the JVM; only files that have one go through the fold over their lines (blocks are a stack), in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.functions.scoring import category
from lodesift.session import ship

#: The word before ``:ignore``.
KEYWORD = "scan"
# What a line starts with that a directive passes over.
PASSED = r"^\s*(?://|#|--|/\*|\*|<!--|rem |REM )|^\s*$"
_PASSED = re.compile(PASSED)


@lru_cache(maxsize=8)
def _directive(keyword: str) -> re.Pattern[str]:
    return re.compile(rf"{re.escape(keyword)}:ignore(-start|-end)?\b[ \t]*(.*)", re.I)


def ranges(text: str, keyword: str = KEYWORD) -> list[tuple[int, int, str, str]]:
    """``first, last, target, reason`` of the lines of a text each target is turned off in; others than ends need a target."""
    lines = text.split("\n")
    out: list[tuple[int, int, str, str]] = []
    waiting: list[tuple[str, str]] = []  # of directives whose next line of code hasn't come
    blocks: list[tuple[int, list[str], str]] = []
    for no, line in enumerate(lines, 1):
        m = _directive(keyword).search(line) if ":" in line else None
        if m is None:
            if waiting and not _PASSED.search(line):
                out += [(no, no, t, why) for t, why in waiting]
                waiting = []
            continue
        kind, rest = (m.group(1) or "").lower(), m.group(2).strip()
        head, _, why = rest.partition("--")
        targets, why = head.lower().split(), why.strip()
        if kind == "-end":
            if blocks:
                first, some, because = blocks.pop()
                out += [(first, no, t, because) for t in some]
        elif targets and kind == "-start":
            blocks.append((no, targets, why))
        elif targets:
            if waiting and not _PASSED.search(line):
                out += [(no, no, t, w) for t, w in waiting]
                waiting = []
            out += [(no, no, t, why) for t in targets]
            waiting += [(t, why) for t in targets]
    return out + [(first, len(lines), t, why) for first, some, why in blocks for t in some]


def covered(files: DataFrame, key: str, keyword: str = KEYWORD, content: str = "content") -> DataFrame:
    """``key, first, last, target, reason``: the ranges of lines each target is turned off in.

    An end closes the innermost open block; ends without one are passed over. Files without content or directive have none.
    """
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in ranges(t, keyword)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], [key, "first", "last", "target", "reason"])

    rows = files.where(F.contains(F.lower(content), F.lit(f"{keyword.lower()}:ignore"))).select(key, content)
    return rows.mapInArrow(run, f"{key} {kind}, first int, last int, target string, reason string")


def split(findings: DataFrame, the_ranges: DataFrame, key: str) -> DataFrame:
    """``findings`` with ``suppressed`` and ``suppress_reason``: those in a range of a target they meet; of several, that which starts first.

    The ranges of a file come as one array to its findings, so lines are compared within a file and the join is by file only.
    """
    per_file = the_ranges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "last", "target", "reason"))).alias("__ranges"))
    met = F.filter(
        "__ranges",
        lambda r: F.col("line_number").between(r["first"], r["last"]) & ((r["target"] == "all") | (r["target"] == F.lower("rule_id")) | (r["target"] == category(F.col("rule_id")))),
    )
    f = findings.join(per_file, key, "left").withColumn("__met", met)
    return f.withColumns({"suppressed": F.coalesce(F.size("__met") > 0, F.lit(False)), "suppress_reason": F.get("__met", F.lit(0))["reason"]}).drop("__ranges", "__met")
