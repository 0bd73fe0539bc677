"""Mixing: the water level, the caps, the shares reached."""

import random

import pytest

from lodesift.llm import mixing


def brute(targets, sizes, total):
    """The level by bisection: each source gives the smaller of its cap and level times share."""
    caps = {s: c * sizes.get(s, 0) for s, (_, c) in targets.items()}
    low, high = 0.0, 1e15
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(caps[s], mid * w) for s, (w, _) in targets.items()) < total:
            low = mid
        else:
            high = mid
    return {s: min(caps[s], high * w) for s, (w, _) in targets.items()}


def test_water_fill_against_bisection(spark):
    r = random.Random(2)
    for many in (1, 2, 3, 5, 7, 7, 7, 60):
        targets = {f"s{i}": (r.choice([0.0, r.random(), 1.0]), r.randint(0, 4)) for i in range(many)}
        sizes = {s: r.choice([0, r.randint(1, 1000)]) for s in targets}
        docs = spark.createDataFrame([(s, n) for s, n in sizes.items() if n], "source string, n_tokens long")
        goal = spark.createDataFrame([(s, w, c) for s, (w, c) in targets.items()], "source string, target_share double, max_repeats int")
        for total in (r.randint(1, 300), r.randint(1, 3000 * many)):
            got = {x.source: x.planned for x in mixing.plan(docs, goal, total).collect()}
            want = brute(targets, sizes, total)
            assert set(got) == set(targets)
            for s in targets:
                assert got[s] == pytest.approx(want[s], rel=1e-6, abs=1e-6)


def test_many_targets(spark):
    """More targets than fit a driver's table are no other case."""
    docs = spark.range(20_000).selectExpr("concat('s', id) AS source", "1 + id % 7 AS n_tokens")
    goal = spark.range(20_000).selectExpr("concat('s', id) AS source", "1.0D AS target_share", "CAST(1 + id % 3 AS INT) AS max_repeats")
    x = mixing.plan(docs, goal).selectExpr("count(*) AS n", "sum(planned) AS given", "sum(n_tokens) AS there", "max(planned / n_tokens - max_repeats) AS over").first()
    assert x.n == 20_000 and x.given == pytest.approx(x.there) and x.over <= 1e-9


def test_names(spark):
    df = spark.createDataFrame([(" Rule-Doc\n",), ("RULE DOC",), (None,)], "s string")
    assert [r.x for r in df.select(mixing.source_name(df.s).alias("x")).collect()] == ["rule_doc", "rule_doc", None]


def test_mix(spark):
    r = random.Random(4)
    docs = [(i, r.choice(["big", "small", "other"]) if i % 50 else "tiny", r.randint(1, 200)) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").cache()
    targets = spark.createDataFrame([("Big ", 0.5, 2), ("small", 0.3, 3), ("tiny", 0.2, 4), ("gone", 0.1, 9), (None, 0.4, 1)], "source string, target_share double, max_repeats int")
    p = mixing.plan(df, targets).cache()
    taken = mixing.mix(df, p, seed=3).cache()
    cap = {"big": 2, "small": 3, "tiny": 4}
    assert all(t.n_copies <= cap[t.source] for t in taken.collect())
    rep = {x.source: x for x in mixing.report(p, taken).collect()}
    assert "other" not in rep and rep["gone"].tokens_taken == 0 and rep["gone"].at_cap
    for x in rep.values():
        assert abs(x.tokens_taken - x.planned) <= max(200, 0.01 * x.planned)
    assert rep["tiny"].at_cap and rep["tiny"].epochs == 4.0
    again = mixing.mix(df.repartition(7), p, seed=3)
    assert {tuple(x) for x in again.collect()} == {tuple(x) for x in taken.collect()}
    assert {tuple(x) for x in mixing.mix(df, p, seed=4).collect()} != {tuple(x) for x in taken.collect()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    p = mixing.plan(docs, targets)
    assert mixing.mix(docs, p).count() == 0
    x = mixing.report(p, mixing.mix(docs, p)).first()
    assert x.share_reached == 0 and x.epochs == 0
    assert mixing.plan(docs, targets.limit(0)).count() == 0


def test_sized(spark):
    docs = spark.createDataFrame([(1, "a b", " A "), (2, None, "a"), (3, "x", None), (4, "", "a")], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.sized(docs).collect()] == [(1, "a", 2)]


def test_shares_reached_lie_within_a_document(spark):
    """On the given documents every source gives what was planned, to within its largest bin; no document has more copies than allowed."""
    docs = mixing.sized(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    p = mixing.plan(docs, spark.read.parquet("/root/testdata/sf0.01/mix_targets.parquet")).cache()
    bins = docs.selectExpr("source", f"pmod(xxhash64(0, doc_id), {mixing.BINS}) AS bin", "n_tokens").groupBy("source", "bin").sum("n_tokens").groupBy("source").max("sum(n_tokens)").collect()
    largest = {r[0]: r[1] for r in bins}
    rows = mixing.report(p, mixing.mix(docs, p)).collect()
    assert sum(r.tokens_taken for r in rows) > 0
    for r in rows:
        assert abs(r.tokens_taken - r.planned) <= largest.get(r.source, 0) / 2 + 1, r
        assert r.tokens_taken <= r.max_repeats * r.n_tokens
    docs.unpersist()
    p.unpersist()
