"""Comments of source files as spans, and findings that lie in them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.session import ship, spread

_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_C = rf"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>{_STRINGS}|`(?:[^`\\]|\\.)*`)"
_HASH = r"(?P<c>(?<![^\s;|&(){}])#[^\n]*)|(?P<s>" + _STRINGS + ")"
# How comments (c) and strings (s) are written.
_PATTERNS = {
    "go": _C,
    "javascript": _C,
    "typescript": _C,
    "java": _C,
    "c": _C,
    "cpp": _C,
    "csharp": _C,
    "kotlin": _C,
    "swift": _C,
    "rust": _C,
    "groovy": _C,
    "zig": _C,
    "php": rf"(?P<c>(?://|\#(?!\[))[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>{_STRINGS})",
    "python": r"(?P<s>[rRbBuUfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|" + _STRINGS + r"))|(?P<c>#[^\n]*)",
    "ruby": r"(?P<c>(?m:^=begin\b.*?(?:^=end[^\n]*|\Z))|(?<![^\s;(){}\[\],])#(?!\{)[^\n]*)|(?P<s>" + _STRINGS + ")",
    "shell": _HASH,
    "perl": _HASH,
    "yaml": _HASH,
    "terraform": r"(?P<c>(?:#|//)[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>" + _STRINGS + ")",
    "dockerfile": r"(?P<c>(?m:^\s*#[^\n]*))|(?P<s>" + _STRINGS + ")",
    "sql": r"(?P<c>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>'(?:[^']|'')*')",
    "lua": r"(?P<c>--\[\[.*?(?:\]\]|\Z)|--[^\n]*)|(?P<s>" + _STRINGS + ")",
}


@lru_cache(maxsize=64)
def _pattern(language: str) -> re.Pattern[str] | None:
    p = _PATTERNS.get(language)
    return re.compile(p, re.S) if p else None


def comment_spans(text: str, language: str) -> list[tuple[int, int]]:
    """The character spans of comments, end exclusive; strings are passed over."""
    p = _pattern(language)
    return [m.span() for m in p.finditer(text) if m.lastgroup == "c"] if p else []


def spans(files: DataFrame, key: str) -> DataFrame:
    """``key, start, end, start_line, end_line`` of every comment of the files (``key, lang, content``)."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for k, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                line, at = 1, 0
                for a, e in comment_spans(text, lang):
                    line += text.count("\n", at, a)
                    for c, x in zip(cols, (k, a, e, line, line + text.count("\n", a, e)), strict=True):
                        c.append(x)
                    at = a
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *[pa.array(c, pa.int32()) for c in cols[1:]]], [key, "start", "end", "start_line", "end_line"])

    rows = files.where(F.col("content").isNotNull() & F.col("lang").isNotNull()).select(key, "lang", "content")
    return spread(rows).mapInArrow(run, f"{key} {kind}, start int, end int, start_line int, end_line int")


def with_spans(files: DataFrame, key: str, column: str = "comment_spans") -> DataFrame:
    """``key, path, lang, content`` of ``files`` and the spans of their comments as an array, in one pass; files without content have none."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": a, "end": e} for a, e in comment_spans(text, lang)] if text and lang else [] for lang, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pairs)], [*b.schema.names, column])

    return spread(files.select(key, "path", "lang", "content")).mapInArrow(run, f"{key} {kind}, path string, lang string, content string, {column} array<struct<start:int,end:int>>")


def begins_in(content: str, comment_spans_: str, line: str, matched: str) -> Column:
    """Whether a match begins in a comment, from the columns of its file's text and comments, its line and its text.

    The match is looked for from its line on; where it isn't found, the start of the line counts. Without line it doesn't.
    """
    starts = F.char_length(F.expr(rf"substring_index({content}, '\n', {line} - 1)")) + F.when(F.col(line) > 1, 1).otherwise(0)
    found = F.instr(F.substring(content, starts + 1, F.char_length(content)), F.coalesce(matched, F.lit("")))
    place = starts + F.greatest(found, F.lit(1)) - 1
    return F.coalesce(F.exists(comment_spans_, lambda s: (s["start"] <= place) & (place < s["end"])) & (F.col(line) > 0), F.lit(False))


def outside(findings: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """The findings whose match doesn't begin in a comment; of other files, and without line, they are kept.

    For findings that come from elsewhere; those of ``rules.apply`` are tested in the row of their file, without this join.
    """
    texts = with_spans(files, key).select(key, F.col("content").alias("__text"), F.col("comment_spans").alias("__spans"))
    return findings.join(texts, key, "left").where(~begins_in("__text", "__spans", "line_number", "matched_text")).drop("__text", "__spans")
