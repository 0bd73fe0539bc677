"""Token ids of whole texts by a public tokenizer.

Texts are cut into overlapping chunks that are pre-tokenised on their own. Pre-tokens are found from left to right
and never look back, so as soon as two neighbouring chunks have one border in common, all later borders agree: there the
text is cut, and the pieces are encoded on their own. Joining the pieces' ids in order gives the ids of the whole text.

The chunks of a text up to ``SPREAD`` characters are worked on where the text lies, without a shuffle; if an overlap has no shared border, it
is made longer. A longer text is first cut, by the same rule, into chunks of ``SPREAD`` characters that go to separate tasks; if one of its overlaps
has no shared border (one run of letters longer than it), it goes through as a whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodesift.session import ship, spread

#: Where the vocabulary files are; a parameter of every function, never copied.
TOKENIZERS = os.environ.get("LODESIFT_TOKENIZERS", "/opt/tokenizers")
#: Characters of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 1 << 10, 1 << 8
#: Characters of a text from which its chunks are spread over the tasks.
SPREAD = 1 << 18
#: Rows whose ids a task holds at once.
ROWS = 256
_NONE = np.zeros(0, np.int32)

# The pre-token pattern that belongs to the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRETOKEN = regex.compile(PATTERN)
_BLANK = regex.compile(r"\s")


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Any:
    """The tokenizer of a process, read from ``<folder>/<name>.tiktoken``; it knows no special tokens."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def decode(ids: Iterable[int], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """The text of ``ids``: their raw bytes joined, then read as UTF-8."""
    return encoding(name, folder).decode_bytes(list(ids)).decode("utf-8", errors="replace")


def borders(text: str, start: int, end: int) -> list[int]:
    """The pre-token starts in ``[start, end)`` when pre-tokenising ``text`` from ``start``."""
    out = []
    for m in _PRETOKEN.finditer(text, start):
        if m.start() >= end:
            break
        out.append(m.start())
    return out


def shared_border(window: str, at: int) -> int | None:
    """The first border that pre-tokenising ``window`` from 0 and from ``at`` have in common, or None.

    The last pre-token of the window may go on beyond it, so only borders before it count; nor do borders behind white space,
    since at the end of a piece its last run would be taken as one.
    """
    own = set(borders(window, 0, len(window))[:-1])
    return next((b for b in borders(window, at, len(window))[:-1] if b in own and not _BLANK.match(window, b - 1)), None)


def pieces(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """``text`` cut at borders that neighbouring chunks share; an overlap without one is doubled until it has one or the text ends."""
    out, start, n = [], 0, len(text)
    while n - start > chunk:
        reach, found = overlap, None
        while found is None:
            found = shared_border(text[start : start + chunk + reach], chunk)
            if start + chunk + reach >= n:
                break
            reach *= 2
        if found is None:
            break
        out.append(text[start : start + found])
        start += found
    out.append(text[start:])
    return out


def _encoded(df: DataFrame, key: str, text: str, name: str, folder: str, chunk: int, overlap: int) -> DataFrame:
    """``key`` columns and ``ids`` of each row's text; null and empty texts give an empty list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                ids = [np.asarray([x for p in pieces(t, chunk, overlap) for x in enc.encode_ordinary(p)], np.int32) if t else _NONE for t in texts]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else _NONE))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "ids"])

    ship(df.sparkSession)
    keys = key.split(",")
    types = dict(df.dtypes)
    return df.select(*keys, text).mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", ids array<int>")


def _spread_pieces(long: DataFrame, doc_id: str, text: str, chunk: int, overlap: int) -> DataFrame:
    """``doc_id, part, piece``: long texts cut at borders that neighbouring chunks share, each overlap looked at by a task of its own."""
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), n - 1, F.lit(chunk))
    chunks = long.select(doc_id, n.alias("n"), text, F.posexplode(starts).alias("part", "at")).select(
        doc_id, "part", "n", F.substring(text, F.col("at") + 1, F.lit(chunk + overlap)).alias("piece")
    )

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = [], []
            for t in batch.column(3).to_pylist():
                if len(t) <= chunk:
                    found.append(None)
                    ends.append(True)
                    continue
                found.append(shared_border(t, chunk))
                ends.append(found[-1] is not None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32()), pa.array(ends, pa.bool_())], [*batch.schema.names, "upto", "good"])

    kind = dict(long.dtypes)[doc_id]
    # chunks of one text are dealt out, so that it isn't pre-tokenised by one task
    marked = chunks.repartition(doc_id, "part").mapInArrow(shared, f"{doc_id} {kind}, part int, n int, piece string, upto int, good boolean")
    w = Window.partitionBy(doc_id)
    cut = marked.withColumn("since", F.coalesce(F.lag("upto").over(w.orderBy("part")) - chunk, F.lit(0))).withColumn("whole", ~F.min("good").over(w))
    good = cut.where(~F.col("whole")).select(doc_id, "part", F.substring("piece", F.col("since") + 1, F.coalesce(F.col("upto"), F.char_length("piece")) - F.col("since")).alias("piece"))
    # texts without a shared border in some overlap: the chunks without their overlaps, joined again
    rest = cut.where("whole").groupBy(doc_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.left("piece", F.lit(chunk)).alias("x")))), lambda s: s["x"]), "").alias("piece"))
    return good.unionByName(rest.select(doc_id, F.lit(0).alias("part"), "piece"))


def encode(df: DataFrame, doc_id: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP, spread_from: int = SPREAD) -> DataFrame:
    """``doc_id, ids`` of every row of ``df``.

    Null and empty texts give an empty list, strings of special tokens are ordinary text, and repeated rows come out each,
    whatever their length and ``doc_id``. Other columns are ignored.
    """
    rows = spread(df.select(doc_id, text))
    is_long = F.coalesce(F.char_length(text) > spread_from, F.lit(False))
    short = _encoded(rows.where(~is_long), doc_id, text, name, folder, chunk, overlap)
    # equal rows are encoded once and come out as often as there are; the key has no null, which a window or a join could lose
    row = F.struct(F.struct(F.col(doc_id).alias("id")).alias("doc"), F.sha2(F.encode(text, "UTF-8"), 256).alias("hash"), F.char_length(text).alias("n"))
    long = df.where(is_long).select(row.alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    long = long.select(F.struct("key", "copies").alias("key"), "text")
    spread_out = _encoded(_spread_pieces(long, "key", "text", spread_from, 4 * overlap), "key,part", "piece", name, folder, chunk, overlap)
    joined = spread_out.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda s: s["ids"])).alias("ids"))
    each = joined.select(F.col("key.key.doc.id").alias(doc_id), "ids", F.explode(F.sequence(F.lit(1), F.col("key.copies").cast("int"))).alias("copy"))
    return short.unionByName(each.select(doc_id, "ids"))


def counts(df: DataFrame, doc_id: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, n_tokens`` of every row; null and empty texts have 0."""
    return encode(df, doc_id, text, name, folder).select(doc_id, F.size("ids").cast("bigint").alias("n_tokens"))
