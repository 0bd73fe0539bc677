"""The core problems' operators on small tables with the awkward cases."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodesift.functions.times import epoch_seconds
from lodesift.operators import entity_features, orphans, shred
from lodesift.plans import problems

FINDING = "finding_id long, entry_id long, rule_id string, severity int, severity_label string, title string, description string, file_path string, line_number int, col_no int, matched_text string, suggestion string, cwe_id string, owasp_category string, lang string, confidence string, confidence_score double, tags array<string>, recorded_at timestamp, n_members int, __id int"


def finding(i, **more):
    base = dict(finding_id=i, entry_id=1, rule_id="INJ-001", severity=2, severity_label=None, title=None, description=None, file_path="/a", line_number=3, col_no=None, matched_text=None, suggestion=None, cwe_id="CWE-89", owasp_category=None, lang=None, confidence="low", confidence_score=None, tags=None, recorded_at=datetime(2025, 1, 1), n_members=7, __id=9)
    base.update(more)
    return tuple(base[c.split()[0]] for c in FINDING.split(", "))


def survivors(spark, rows):
    return {r["first_id"]: r.asDict() for r in problems.finding_survivors(spark.createDataFrame(rows, FINDING)).collect()}


def test_survivor_order_and_fill(spark):
    rows = [
        finding(1, tags=["taint-analysis"], severity=1, cwe_id="cwe-089", title=" "),
        finding(2, rule_id="pyast-1", severity=4, title="t2", suggestion="s2"),
        finding(3, tags=["interprocedural", "taint-analysis"], severity=4, title="t3", matched_text="m3"),
    ]
    got = survivors(spark, rows)[1]
    assert got["best_id"] == 1 and got["n_members"] == 3
    assert got["title"] == "t2" and got["suggestion"] == "s2" and got["matched_text"] == "m3"
    assert got["filled_from"]["title"] == 2 and got["filled_from"]["matched_text"] == 3


@pytest.mark.parametrize(
    ("a", "b", "best"),
    [
        ({"severity": 3}, {"severity": 2}, 1),
        ({"confidence": " LOW"}, {"confidence": "Medium"}, 2),
        ({"confidence": None}, {"confidence": "low"}, 2),
        ({"rule_id": "B-1"}, {"rule_id": " a-9 "}, 2),
        ({"rule_id": "AB"}, {"rule_id": "ABC"}, 1),
        ({"recorded_at": None}, {"recorded_at": datetime(2024, 1, 1)}, 2),
        ({}, {}, 1),
        ({"severity": None}, {"severity": 0}, 2),
    ],
)
def test_survivor_ties(spark, a, b, best):
    assert survivors(spark, [finding(1, **a), finding(2, **b)])[1]["best_id"] == best


def test_no_group_without_line_or_number(spark):
    rows = [finding(1, line_number=0), finding(2, line_number=0), finding(3, cwe_id="n/a"), finding(4, cwe_id=None), finding(5, line_number=None), finding(6, line_number=None), finding(7, entry_id=None), finding(8, entry_id=None), finding(9), finding(9)]
    assert survivors(spark, rows) == {}
    assert survivors(spark, []) == {}


def test_survivors_of_a_hot_group(spark):
    """One group of thousands of rules, each newer and less trusted than the one before: the whole group is the skyline."""
    from datetime import timedelta

    rows = [finding(i, rule_id=f"R{i:05d}", recorded_at=datetime(2025, 1, 1) + timedelta(minutes=i), title="t" if i == 1500 else None) for i in range(1, 3001)]
    got = survivors(spark, rows)
    assert len(got) == 1 and got[1]["best_id"] == 1 and got[1]["n_members"] == 3000 and got[1]["n_skyline"] == 3000 and got[1]["title"] == "t"


def test_survivors_against_brute_force(spark):
    import random

    r = random.Random(5)
    rows = [finding(i, entry_id=r.randint(1, 4), line_number=r.randint(1, 3), severity=r.choice([None, 1, 2]), rule_id=r.choice(["A", "B"]), title=r.choice([None, "x", "y"]), suggestion=r.choice([None, "p"]), recorded_at=datetime(2025, 1, r.randint(1, 9))) for i in range(1, 121)]
    got = survivors(spark, rows)
    groups = {}
    for t in rows:
        d = dict(zip([c.split()[0] for c in FINDING.split(", ")], t, strict=True))
        groups.setdefault((d["entry_id"], d["line_number"]), []).append(d)
    for g in groups.values():
        if len(g) < 2:
            continue
        g.sort(key=lambda d: (-(d["severity"] if d["severity"] is not None else -1), d["rule_id"], -d["recorded_at"].timestamp(), d["finding_id"]))
        one = got[min(d["finding_id"] for d in g)]
        # the layers, by comparing all pairs in the policy's order
        filled = [{k for k in ("title", "suggestion") if d[k]} for d in g]
        layer = []
        for j, d in enumerate(g):
            layer.append(1 + max((layer[i] for i in range(j) if g[i]["recorded_at"] >= d["recorded_at"] and filled[i] >= filled[j]), default=0))
        assert one["n_skyline"] == layer.count(1)
        for k in ("title", "suggestion"):
            donor = min(((layer[j], j) for j in range(len(g)) if g[j][k]), default=None)
            assert one[k] == (g[donor[1]][k] if donor else None)
        assert one["best_id"] == g[0]["finding_id"]
        assert (one["title"] is None) == all(d["title"] is None for d in g)


def test_times(spark):
    rows = [("2025-09-01T10:32:45+09:00", 1756690365), ("2025-09-01T01:32:45Z", 1756690365), ("2025-09-01 01:32:45", 1756690365), ("2025-09-01T01:32:45.999Z", 1756690365), ("1756690365", 1756690365), ("2025-09-01T01:32:45+0130", 1756684965), ("0000-00-00T00:00:00Z", None), ("0000-01-01T00:00:00Z", None), ("", None), ("n/a", None), (None, None), ("2025-02-30T00:00:00Z", None), (" 2025-09-01 ", 1756684800), ("2025-09-01T25:00:00Z", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", epoch_seconds(F.col("t")).alias("e"))
    assert {r.i: r.e for r in df.collect()} == {i: e for i, (_, e) in enumerate(rows)}


LEDGER = "entry_id long, logged_at string, session_id string, event string, file_path string, lang string, finding_count int, max_severity string, blocked boolean, event_type string"


def test_session_types(spark):
    rows = [
        (1, "2025-09-01T00:00:00Z", " S1\n", "PreToolUse", "/a", "Go ", 2, "HIGH", True, "x"),
        (2, "2025-09-01 00:00:00.5", "s1", "pretooluse", "/a", "go", 2, "high", True, "x"),
        (3, "2025-09-01T00:00:01Z", "s1", "PreToolUse", "/a", "go", None, "high", None, "x"),
        (4, "2025-09-01T00:00:01Z", "s1", "PreToolUse", None, None, 1, "low", False, "x"),
        (5, "nope", "s1", "PreToolUse", "/a", "go", 5, "high", True, "x"),
        (6, "2025-09-01T00:00:01Z", "  ", "PreToolUse", "/a", "go", 5, "high", True, "x"),
        (7, "2025-09-01T00:00:01Z", None, "PreToolUse", "/a", "go", 5, "high", True, "x"),
    ]
    got = {(r.session_id, r.event_type): (r.n_entries, r.n_blocked, r.n_findings, r.last_epoch) for r in problems.session_types(spark.createDataFrame(rows, LEDGER)).collect()}
    assert got == {("s1", "pretooluse/go/high"): (2, 1, 2, 1756684801), ("s1", "pretooluse/*/low"): (1, 0, 1, 1756684801)}
    assert problems.session_types(spark.createDataFrame([], LEDGER)).collect() == []


def test_feature_table_keeps_unlisted_types(spark):
    long = spark.createDataFrame([("a", "k1", 2, 5), ("a", "zz", 1, 9), ("a", "yy", 1, 7), ("b", "k2", 1, 1)], "e string, kind string, n long, last long")
    got = {r["e"]: r.asDict() for r in entity_features.feature_table(long, "e", "kind", ["n", "last"], ["k1", "k2"], recency_of="last").collect()}
    assert got["a"]["k1__n"] == 2 and got["a"]["k2__n"] == 0 and got["a"]["k2__last"] is None
    assert got["a"]["other__n"] == 2 and got["a"]["other__last"] == 9


def brute_children(payload):
    """A plain recursion over the parsed payload, written apart from the operator."""
    try:
        v = json.loads(payload)
        while isinstance(v, str):
            v = json.loads(v)
    except (TypeError, ValueError):
        return set()
    if not isinstance(v, dict):
        return set()
    out = set()

    def get(o, *names):
        for n in names:
            if isinstance(o, dict) and n in o:
                x = o[n]
                if isinstance(x, str) and x[:1] in "[{":
                    x = json.loads(x)
                return x
        return None

    def items(x):
        return [] if x is None else list(enumerate(x)) if isinstance(x, list) else [(0, x)]

    for i, f in items(get(v, "findings")):
        if f is None:
            continue
        out.add(("findings", f"{i}"))
        out |= {("findings.tags", f"{i}/{j}") for j, t in items(get(f, "tags")) if t is not None}
        out |= {("findings.flow.steps", f"{i}/{j}") for j, t in items(get(get(f, "flow"), "steps")) if t is not None}
    for place, names in (("suppressed_rules", ("suppressed_rules", "suppressedRules")), ("calls", ("calls",)), ("called_by", ("called_by", "calledBy"))):
        out |= {(place, f"{i}") for i, x in items(get(v, *names)) if x is not None}
    sig = get(v, "taint_sig", "taintSig")
    if sig is not None:
        out.add(("taint_sig", "0"))
        for place, names in (("sink_calls", ("sink_calls", "sinkCalls")), ("suppressed_sinks", ("suppressed_sinks", "suppressedSinks")), ("sanitized_paths", ("sanitized_paths", "sanitizedPaths"))):
            out |= {(f"taint_sig.{place}", f"{i}") for i, x in items(get(sig, *names)) if x is not None}
        out |= {("taint_sig.tainted_params", f"{k}/{i}") for k, c in (get(sig, "tainted_params", "taintedParams") or {}).items() for i, x in items(c) if x is not None}
        out |= {("taint_sig.source_params", k) for k, x in (get(sig, "source_params", "sourceParams") or {}).items() if x is not None}
    ti = get(v, "tool_input", "toolInput")
    if ti is not None:
        out.add(("tool_input", "0"))
        out |= {("tool_input.edits", f"{i}") for i, x in items(get(ti, "edits")) if x is not None}
    if get(v, "tool_response", "toolResponse") is not None:
        out.add(("tool_response", "0"))
    return out


def test_shred_cases(spark):
    payloads = [
        None,
        "",
        "  \n",
        '{"findings": [{"tags": ["a", null, "b"]}, null, {"flow": {"steps": {"line": 1}}, "tags": "x"}]}',
        '{"findings": "[{\\"tags\\": []}]", "suppressedRules": "R1"}',
        '{"findings": [{"ta',
        '"{\\"calledBy\\": [null, \\"x\\"], \\"calls\\": null}"',
        '{"taintSig": "{\\"sinkCalls\\": [null, {}]}"}',
        '{"taint_sig": {"tainted_params": {"0": ["a", "b"], "2": null, "x": "c"}, "source_params": {"1": "n", "2": null}}}',
        '{"toolInput": {"filePath": "/a", "edits": [{"oldString": "a"}]}, "tool_response": {}}',
        '{"tool_input": null}',
        "[1, 2]",
        "null",
        json.dumps({"findings": [{"title": "y" * 200_000, "tags": ["t"] * 50}]}),
    ]
    df = spark.createDataFrame([(i, p, 1) for i, p in enumerate(payloads)], "record_id long, payload string, place int")
    got = {}
    for r in shred.entities(shred.adjacency(df, "record_id", "payload")).collect():
        got.setdefault(r.record_id, set()).add((r.child_path, r.pos_path))
    assert got == {i: c for i, p in enumerate(payloads) if (c := brute_children(p))}
    assert shred.adjacency(spark.createDataFrame([], "record_id long, payload string"), "record_id", "payload").count() == 0


def test_shred_real_records(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/raw_records.parquet")
    got = {}
    for r in shred.entities(shred.adjacency(df, "record_id", "payload")).collect():
        got.setdefault(r.record_id, set()).add((r.child_path, r.pos_path))
    want = {r.record_id: c for r in df.collect() if (c := brute_children(r.payload))}
    assert got == want


def test_shredded_tables_join_again(spark):
    p = '{"findings": [{"rule_id": "A", "tags": ["t"], "flow": {"scope": "s", "confidence": 0.5, "steps": [{"line": 7}]}}, {"ruleId": "B"}]}'
    nodes = shred.adjacency(spark.createDataFrame([(1, p)], "record_id long, payload string"), "record_id", "payload").cache()
    f = shred.entity(nodes, "findings", ("rule_id", "flow.scope", "flow.confidence"))
    rows = {r.pos_path: r for r in f.collect()}
    assert rows["0"].rule_id == "A" and rows["0"].flow_scope == "s" and rows["0"].flow_confidence == "0.5" and rows["1"].rule_id == "B" and rows["1"].flow_scope is None
    steps = shred.entity(nodes, "findings.flow.steps", ("line",))
    joined = steps.alias("s").join(f.alias("f"), (F.col("s.record_id") == F.col("f.record_id")) & (F.col("s.owner") == F.col("f.node"))).select("f.rule_id", "s.line").collect()
    assert [(r.rule_id, r.line) for r in joined] == [("A", "7")]


def test_shred_loses_nothing(spark):
    """Lone surrogates, deep nesting, long numbers, texts in texts, repeated names, unknown fields; every scalar is in a flat table."""
    deep = '{"a": ' * 20_000 + "1" + "}" * 20_000
    wrapped = json.dumps({"calls": ["x"]})
    for _ in range(6):
        wrapped = json.dumps(wrapped)
    payloads = [
        '{"calls": ["\\ud800", "ok\\ud83d\\ude00"], "note": "\\udfff"}',
        '{"findings": [{"rule_id": "R", "more": ' + deep + "}]}",
        '{"calls": ["a"], "n": ' + "7" * 5000 + ', "m": 1e999, "k": -0.50}',
        wrapped,
        '{"calls": ["a"], "calls": ["b", "c"], "x": 1, "x": 2, "x": 3}',
        '{"tool_input": {"new_string": "n", "odd": {"p": [1, {"q": true}], "e": {}, "z": []}}, "sessionId": "s", "session_id": "t", "free": [[1], "w"]}',
        '{"toolResponse": "done", "taint_sig": {"source_params": {"0": {"why": "w"}, "1": "net"}, "tainted_params": "odd"}}',
        '{"a": 1,}',
        '{"a": ' * 20_000 + "1" + "}" * 19_999,
        "[" * 30_000 + "]" * 30_000,
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string")
    nodes = shred.adjacency(df, "record_id", "payload").cache()
    got = {}
    for r in shred.entities(nodes).collect():
        got.setdefault(r.record_id, {})[(r.child_path, r.pos_path)] = (r.value, r.fields)
    assert got[0] == {("calls", "0"): ("\ufffd", {}), ("calls", "1"): ("ok\U0001f600", {})}
    f = got[1][("findings", "0")][1]
    assert f["rule_id"] == "R" and sorted(f.values()) == ["1", "R"] and len(got[1]) == 1
    assert nodes.where("record_id = 1").count() == 20_000 + 5
    assert set(got[2]) == {("calls", "0")} and set(got[3]) == {("calls", "0")} and set(got[4]) == {("calls", "0"), ("calls", "1")}
    assert got[5][("tool_input", "0")][1] == {"new_string": "n", "odd.p[0]": "1", "odd.p[1].q": "true", "odd.e": "{}", "odd.z": "[]"}
    assert got[6] == {("tool_response", "0"): ("done", {}), ("taint_sig", "0"): (None, {"tainted_params[0]": "odd"}), ("taint_sig.source_params", "0"): (None, {"why": "w"}), ("taint_sig.source_params", "1"): ("net", {})}
    assert not {7, 8, 9} & set(got)
    root = {r.record_id: r for r in shred.roots(nodes, ("session_id", "x")).collect()}
    assert root[0].rest == {"note": "\ufffd"} and root[2].rest == {"n": "7" * 5000, "m": "1e999", "k": "-0.5"}
    assert root[4].x == "3" and sorted(root[4].rest.values()) == ["1", "2", "a"]
    assert root[5].session_id == "s" and sorted(root[5].rest.values()) == ["1", "t", "w"]
    table = {r.record_id: r for r in shred.entity(nodes, "tool_input", ("new_string",)).collect()}
    assert table[5].new_string == "n" and set(table[5].rest) == {"odd.p[0]", "odd.p[1].q", "odd.e", "odd.z"} and table[5].owner == 0
    nodes.unpersist()


def test_missing_keys_against_sets(spark):
    import random

    r = random.Random(1)
    parents = [r.randint(-50, 400) for _ in range(300)] + [None]
    refs = [r.randint(-60, 500) for _ in range(400)] + [None, 7, 7]
    p, q = spark.createDataFrame([(x,) for x in parents], "k long"), spark.createDataFrame([(x,) for x in refs], "k long")
    for block in (4, 64, 1 << 14):
        assert {x.key for x in orphans.missing_keys(p, "k", q, "k", block).collect()} == {x for x in refs if x is not None} - set(parents)
    assert {x.key for x in orphans.missing_keys(p.limit(0), "k", q, "k").collect()} == {x for x in refs if x is not None}
    assert orphans.missing_keys(p, "k", q.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        orphans.missing_keys(p, "k", q, "k", 3)


def test_runs(spark):
    got = {(r.start, r.end) for r in orphans.runs(spark.createDataFrame([(x,) for x in (1, 2, 3, 5, 6, 9, 9, None)], "k long"), "k").collect()}
    assert got == {(1, 3), (5, 6), (9, 9)}


def test_node_names(spark):
    cases = {" /a/b.py:f ": "/a/b.py:f", "\\a\\b.py:f": "/a/b.py:f", "/a/./b.py:f": "/a/b.py:f", "/a/x/../b.py:f": "/a/b.py:f", "/../a.py:f": "/a.py:f", "../a.py:f": "../a.py:f", "/a/b.py:..": "/a/b.py:..", "C:/a/../b.py:f": "C:/b.py:f", "x": "x", None: None, "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", orphans.node_name(F.col("c")).alias("n"))
    assert {r.c: r.n for r in df.collect()} == cases


NODE = "node_seq long, op string, id string, calls array<string>, called_by array<string>, last_scan_at timestamp, key int"
GRAPH = "graph_id long, node_ids array<string>, last_updated timestamp, key int"


def test_orphan_references(spark):
    t = [datetime(2025, 1, i) for i in range(1, 10)]
    nodes = [
        (1, "upsert", "/a:f", ["/b:g", "/gone:h", "/gone:h", None, " "], None, t[0], 1),
        (2, "upsert", "/b:g", ["/old:x"], ["/a:f"], t[0], 1),
        (3, "upsert", "/b:g", ["/never:y"], ["/rem:z"], t[1], 1),
        (4, "upsert", "/rem:z", ["/lost:q"], None, t[0], 1),
        (5, "remove", "/rem:z", None, None, t[2], 1),
        (6, "upsert", "/late:k", None, None, t[8], 1),
        (7, "upsert", "/a2:f", ["\\late:k"], None, t[0], 1),
        (8, "remove", "/same:s", None, None, t[0], 1),
        (9, "upsert", "/same:s", ["/x/../gone:h"], None, t[0], 1),
    ]
    graphs = [(5, ["/a:f", "/rem:z", None, "/no:n"], t[3], 1), (6, None, None, 1)]
    n, g = spark.createDataFrame(nodes, NODE), spark.createDataFrame(graphs, GRAPH)
    got = {tuple(r) for r in orphans.orphan_references(n, g).collect()}
    assert got == {("calls", "/a:f", "/gone:h"), ("calls", "/b:g", "/never:y"), ("called_by", "/b:g", "/rem:z"), ("calls", "/same:s", "/gone:h"), ("nodes", "5", "/rem:z"), ("nodes", "5", "/no:n")}
    report = {(r.ref_field, r.month): (r.n_refs, r.n_missing) for r in orphans.orphan_report(n, g).collect()}
    assert report[("nodes", "2025-01")] == (3, 2) and report[("calls", "2025-01")] == (5, 3)
    assert orphans.orphan_references(n.limit(0), g.limit(0)).count() == 0
