"""Token ids: the same as by the other library, for any cut; exact round trips."""

import os
import random

import pytest

from lodesift.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no vocabulary files")
PIECES = ["a" * 50, "  ", "\n\n", " x", "'s", "don't ", "12345", "!!!", "é", "日本語", "\r\n", "\t ", "  \n b", "🙂", "<|endoftext|>", "\u3000", "\x1c"]


def texts(n, longest, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(1, longest))) for _ in range(n)]


def test_same_as_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = list(enumerate([*texts(200, 60, 1), "", None, "x" * 70_000, " " * 70_000, "ab1 " * 40_000]))
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df, "doc_id", "text").collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else [])
        assert tokens.decode(got[i]) == (x or "")


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 20), (33, 8), (128, 127)])
def test_any_cut_gives_the_same(spark, chunk, overlap):
    rows = list(enumerate(texts(150, 120, chunk)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    enc = tokens.encoding()
    want = {i: enc.encode_ordinary(x) for i, x in rows}
    assert max(len(tokens.pieces(x, chunk, overlap)) for _, x in rows) > 5
    for spread_from in (tokens.SPREAD, 3 * chunk):  # in one task, and spread over several
        got = {r.doc_id: list(r.ids) for r in tokens.encode(df, "doc_id", "text", chunk=chunk, overlap=overlap, spread_from=spread_from).collect()}
        assert got == want


def test_pieces_of_the_given_texts(spark):
    """The given documents above a chunk are cut, and have the same ids as when encoded whole."""
    enc = tokens.encoding()
    long = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 1024").collect()]
    assert long
    for t in long:
        for chunk in (tokens.CHUNK, 200, 5000):
            cut = tokens.pieces(t, chunk, 64)
            assert "".join(cut) == t and [x for p in cut for x in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    assert sum(len(tokens.pieces(t)) > 1 for t in long) > 0.9 * len(long)
    assert len(tokens.pieces("x" * 5000)) == 1 and len(tokens.pieces("x" * 5000 + " y" * 2000)) > 1


def test_counts_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.counts(df, "doc_id", "text").collect()} == {1: 2, 2: 0, 3: 0}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_repeated_long_rows_come_out_each(spark):
    """Rows of long texts: repeated ones, different texts of one id, null ids."""
    a, b = "ab1 cd " * 30, "xy2, " * 40
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b), (None, b), (2, "s"), (2, "s"), (None, "s")]
    enc = tokens.encoding()
    want = sorted((i or 0, enc.encode_ordinary(t)) for i, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, list(r.ids)) for r in tokens.encode(df, "doc_id", "text", chunk=16, overlap=5, spread_from=64).collect()) == want
    keyed = spark.createDataFrame([((i, "web"), t) for i, t in rows], "k struct<id:long,source:string>, text string")
    assert sorted((r.k.id or 0, list(r.ids)) for r in tokens.encode(keyed, "k", "text", chunk=16, overlap=5, spread_from=64).collect()) == want
