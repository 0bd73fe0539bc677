"""Files as lines, and physical lines joined to logical ones."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.paths import is_comment
from lodesift.session import ship

# Languages whose lines go on behind a backslash.
CONTINUED = ("shell", "c", "cpp")


def lines(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, line_no, text``, lines counted from 1; an empty text is one empty line, null has none. Keeps the trailing empty line."""
    return files.where(F.col(content).isNotNull()).select(key, F.posexplode(F.split(content, "\n", -1)).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def line_of(content: Column, offset: Column) -> Column:
    """The line, from 1, that a character offset from 0 lies in; 0 outside of the text."""
    before = F.left(content, offset)
    inside = (offset >= 0) & (offset < F.char_length(content))
    return F.when(inside, F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"))) + 1).otherwise(0)


def joined(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, line_no, text``: lines whose end, but for blanks, is a backslash are joined with the next, without it.

    ``line_no`` is the first physical line, so that findings keep their place. Lines are numbered in the text itself, and the ends
    that go on are taken out with the number behind them, so a file is joined where it lies.
    """
    numbered = F.array_join(F.transform(F.split(content, "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\x01"), x)), "\n")
    whole = F.regexp_replace(F.regexp_replace(numbered, r"\\ *\n\d+\x01", ""), r"\\ *\z", "")
    rows = files.where(F.col(content).isNotNull()).select(key, F.explode(F.split(whole, "\n", -1)).alias("x"))
    return rows.select(key, F.substring_index("x", "\x01", 1).cast("int").alias("line_no"), F.substring(F.col("x"), F.instr(F.col("x"), "\x01") + 1, F.char_length("x")).alias("text"))


def comment_counts(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, n_lines, n_comments, n_blank`` of every file with content, counted where it lies."""
    ls = F.split(content, "\n", -1)
    count = lambda test: F.size(F.filter(ls, test)).cast("bigint")
    return files.where(F.col(content).isNotNull()).select(key, F.size(ls).cast("bigint").alias("n_lines"), count(is_comment).alias("n_comments"), count(lambda x: F.trim(x) == "").alias("n_blank"))


def bracket_delta(line: str) -> int:
    """Opening less closing brackets of a Python line, outside of strings and comments."""
    depth, quote, i, n = 0, "", 0, len(line)
    while i < n:
        c = line[i]
        if quote:
            if c == "\\":
                i += 1
            elif line.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
        elif c in "\"'":
            quote = c * 3 if line.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c == "#":
            break
        else:
            depth += (c in "([{") - (c in ")]}")
        i += 1
    return depth


def _python_lines(text: str) -> Iterator[tuple[int, str]]:
    start, parts, depth = 0, [], 0
    for i, line in enumerate(text.split("\n"), 1):
        start = start or i
        depth = max(0, depth + bracket_delta(line))
        cut = line.rstrip()
        if cut.endswith("\\") and depth == 0:
            parts.append(cut[:-1].strip() if parts else cut[:-1].rstrip())
            continue
        parts.append(line.strip() if parts else line)
        if depth:
            continue
        yield start, " ".join(parts)
        start, parts = 0, []
    if parts:
        yield start, " ".join(parts)


def joined_python(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, line_no, text`` of Python files: open brackets and backslashes join lines, inner ones trimmed, with one blank."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at, out = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, s in _python_lines(t):
                    keys.append(k)
                    at.append(i)
                    out.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(at, pa.int32()), pa.array(out, pa.string())], [key, "line_no", "text"])

    return files.where(F.col(content).isNotNull()).select(key, content).mapInArrow(run, f"{key} {kind}, line_no int, text string")
