"""The scanner's operators on small tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodesift.functions import paths
from lodesift.functions.text import truncated
from lodesift.sinks import outputs
from lodesift.operators import callgraph, catalogs, comments, fusion, graphbuild, hints, interproc, lines, pyast, pyflow, rules, scan, store, suppress, taint
from lodesift.plans.rule_table import RULES
from lodesift.sources import events


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "input_id long, path string, lang string, content string")


def test_paths(spark):
    rows = {"/a/Dockerfile": "dockerfile", "/a/x.PY": "python", "C:\\x\\y.ts": "typescript", "/a/b": "*", "": "*", None: None, "a.tar.gz": "*"}
    df = spark.createDataFrame([(p,) for p in rows], "p string")
    assert {r.p: r.x for r in df.select("p", paths.language(F.col("p")).alias("x")).collect()} == rows
    c = F.col("p")
    flags = {r.p: (r.g, r.v, r.t, r.s) for r in spark.createDataFrame([("vendor/x.go",), ("/a/jquery.js",), ("/a/test_x.py",), ("/a/x.png",), ("/a/FooTest.java",), ("/a/x.go",)], "p string").select("p", paths.is_generated(c).alias("g"), paths.is_vendored(c).alias("v"), paths.is_test(c).alias("t"), paths.is_scannable(c).alias("s")).collect()}
    assert flags == {"vendor/x.go": (True, False, False, False), "/a/jquery.js": (False, True, False, True), "/a/test_x.py": (False, False, True, True), "/a/x.png": (False, False, False, False), "/a/FooTest.java": (False, False, True, True), "/a/x.go": (False, False, False, True)}


def test_truncation_counts_bytes(spark):
    df = spark.createDataFrame([("  abcdef ",), ("abcd",), ("äöü",), (None,)], "t string").select(truncated(F.col("t"), 4).alias("x"))
    assert [r.x for r in df.collect()] == ["abcd...", "abcd", "äö...", None]


def test_events(spark):
    e = '{"session_id": "s", "hook_event_name": "PostToolUse", "tool_name": "Write", "tool_use_id": "u", "tool_input": {"file_path": "", "notebook_path": "/n.py", "content": "a\\r\\nb"}}'
    parsed = events.parse_events(spark.createDataFrame([(e,), ("{broken",), (None,)], "value string"), "value")
    rows = events.files(parsed, key="tool_use_id").collect()
    assert [(r.path, r.content, r.lang, r.is_new) for r in rows] == [("/n.py", "a\nb", "python", True)]
    assert [r.corrupt for r in parsed.collect()][1] == "{broken"
    disk = spark.createDataFrame([("/n.py", "on disk")], "path string, content string")
    assert events.files(parsed, disk, "tool_use_id").first().content == "on disk"


def test_lines_and_continuations(spark):
    f = texts(spark, (1, "/a.sh", "shell", "a \\\nb\\\nc\nd"), (2, "/b", "shell", ""), (3, "/c", "shell", None))
    got = {(r.input_id, r.line_no, r.text) for r in lines.joined(f, "input_id").collect()}
    assert got == {(1, 1, "a bc"), (1, 4, "d"), (2, 1, "")}
    p = texts(spark, (1, "/a.py", "python", "x = [1,\n  2]  # (\ny = '(' \\\n  + z\nw"))
    assert [(r.line_no, r.text) for r in lines.joined_python(p, "input_id").orderBy("line_no").collect()] == [(1, "x = [1, 2]  # ("), (3, "y = '(' + z"), (5, "w")]
    assert lines.bracket_delta('f("(", [') == 2 and lines.bracket_delta("'''(") == 0
    at = spark.createDataFrame([("a\nbc\n", i) for i in (0, 1, 2, 5, 9, -1)], "t string, o int").select(lines.line_of(F.col("t"), F.col("o")).alias("n"))
    assert [r.n for r in at.collect()] == [1, 1, 2, 0, 0, 0]


def test_rule_shapes(spark):
    table = [
        rules.parse({"id": "L-1", "patterns": [{"regex": "foo", "confidence": "high"}, {"regex": "fo", "confidence": "low"}], "languages": ["python"], "safe_patterns": ["safe"]}),
        rules.parse({"id": "G-1", "patterns": ["bar"], "guards": ["needed"], "guards_none": ["never"]}),
        rules.parse({"id": "W-1", "patterns": ["baz"], "near": [{"pattern": "ctx", "before": 1, "after": 1}], "near_none": [{"pattern": "ok", "before": 0, "after": 1}]}),
        rules.parse({"id": "O-1", "patterns": ["dup"], "once": True, "severity": "critical"}),
        rules.parse({"id": "P-1", "patterns": ["any"], "path": "\\.tf$"}),
        rules.parse({"id": "C-1", "patterns": ["TODO"], "comments": True}),
    ]
    f = texts(
        spark,
        (1, "/a.py", "python", "foo\n# foo\nfoo safe\nfo"),
        (2, "/a.go", "go", "foo"),
        (3, "/b", "*", "bar\nneeded"),
        (4, "/b", "*", "bar\nneeded never"),
        (5, "/c", "*", "ctx\nbaz\n\nbaz\nctx ok\n\nctx\nbaz"),
        (6, "/d", "*", "dup\ndup"),
        (7, "/e.tf", "terraform", "any"),
        (8, "/e.py", "python", "any\n# TODO"),
        (9, "/n", "*", None),
        (10, "/n", "*", ""),
    )
    got = sorted((r.input_id, r.rule_id, r.line_number, r.confidence) for r in rules.apply(f, table, "input_id").collect())
    assert got == [(1, "L-1", 1, "high"), (1, "L-1", 4, "low"), (3, "G-1", 1, "medium"), (5, "W-1", 2, "medium"), (5, "W-1", 8, "medium"), (6, "O-1", 1, "medium"), (7, "P-1", 1, "medium"), (8, "C-1", 2, "medium")]
    with pytest.raises(ValueError):
        rules.check_pattern("(?=a)")


def test_rule_table_and_loader(tmp_path):
    assert len({r.rule_id for r in RULES}) == len(RULES) >= 40
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"defaults": {"severity": "low", "cwe": "CWE-1"}, "rules": [{"id": "X-001", "patterns": ["a"]}, {"id": "X-003", "patterns": ["b"]}]}))
    loaded = rules.load(p)
    assert [r.severity for r in loaded] == [1, 1] and rules.coverage(loaded) == [("X", 2, 0, [2])]


def test_builtin_rules_fire(spark):
    cases = {"PY-001": ("python", "subprocess.run(cmd, shell=True)"), "PY-004": ("python", "yaml.load(f)"), "CTR-003": ("dockerfile", "FROM a:latest"), "CRY-001": ("python", "hashlib.md5(x)"), "CRY-005": ("go", "InsecureSkipVerify: true"), "JWT-001": ("javascript", 'algorithms: ["none"]'), "OWN-INJ-01": ("php", '"SELECT x WHERE id = " . $id'), "OWN-TRV-01": ("javascript", 'fs.readFileSync("/data/" + x)'), "PHP-001": ("php", "if ($token == $x) {"), "PHP-003": ("php", "include($_GET['p']);"), "RB-002": ("ruby", "system(params[:c])"), "RB-009": ("ruby", "Marshal.load(x)"), "JAVA-007": ("java", "new X509TrustManager() {"), "GO-012": ("go", "os.MkdirAll(p, 0777)"), "GO-003": ("go", 'http.ListenAndServe(":80", nil)')}
    f = texts(spark, *[(i, "/x", lang, code) for i, (lang, code) in enumerate(cases.values())])
    got = {(r.input_id, r.rule_id) for r in rules.apply(f, RULES, "input_id").collect()}
    assert {(i, r) for i, r in enumerate(cases)} <= got


FINDING = "finding_id long, entry_id long, rule_id string, severity int, file_path string, line_number int, cwe_id string, confidence string, confidence_score double, tags array<string>, title string, matched_text string"


def test_merge_boost_and_pass_through(spark):
    rows = [
        (1, 1, "R-1", 4, "/a", 3, "CWE-89", "high", None, ["x"], None, None),
        (2, 1, "T-1", 2, "/a", 3, "CWE-89", None, 0.95, ["taint-analysis"], None, None),
        (3, 1, "PYAST-1", 4, "/a", 3, "CWE-89", None, None, None, None, None),
        (4, 1, "R-2", 1, "/a", 0, "CWE-89", "low", None, None, None, None),
        (5, 1, "R-2", 1, "/a", 0, "CWE-89", "low", None, None, None, None),
        (6, 1, "R-3", 1, "/a", 3, "", "medium", 0.0, None, None, None),
        (7, 1, "R-4", 1, "/a", 4, "CWE-89", "medium", None, None, None, None),
    ]
    got = {r.finding_id: r for r in fusion.merged(spark.createDataFrame(rows, FINDING)).collect()}
    assert set(got) == {2, 4, 5, 6, 7}
    assert got[2].confidence_score == 1.0 and got[2].tags == ["taint-analysis", "x"] and got[2].n_merged == 3
    assert got[6].confidence_score == 0.4 and got[4].confidence_score == 0.3
    assert fusion.merged(spark.createDataFrame([], FINDING)).count() == 0


def test_downgrade_and_decision(spark):
    rows = [(1, 1, "R-1", 4, "/a/test_x.py", 3, "CWE-1", None, 0.9, None, None, None), (2, 1, "R-1", 4, "/a/x.py", 3, "CWE-1", None, 0.7, None, None, None), (3, 2, "R-1", 4, "/a/x.py", 3, "CWE-1", None, 0.69, None, None, None)]
    f = fusion.downgraded(spark.createDataFrame(rows, FINDING))
    got = {r.finding_id: (r.severity, r.confidence_score, r.confidence, r.severity_label) for r in f.collect()}
    assert got[1] == (1, 0.3, "low", "LOW") and got[2] == (4, 0.7, "high", "CRITICAL")
    d = {(r.entry_id, r.file_path): (r.blocked, r.warned, r.n_findings) for r in fusion.decisions(f).collect()}
    assert d == {(1, "/a/test_x.py"): (False, False, 1), (1, "/a/x.py"): (True, True, 1), (2, "/a/x.py"): (False, True, 1)}


def test_suppressions(spark):
    text = "\n".join(["# scan:ignore INJ-1 injection -- why not", "", "# note", "bad()", "x # SCAN:IGNORE all", "y", "# scan:ignore-start xss", "a", "# scan:ignore-start crypto", "b", "# scan:ignore-end", "c", "# scan:ignore-end", "# scan:ignore-end", "# scan:ignore", "# scan:ignore-start auth", "z"])
    ls = texts(spark, (1, "/a", "python", text), (2, "/b", "python", None), (3, "/c", "python", "x"))
    got = {(r.first, r.last, r.target) for r in suppress.covered(ls, "input_id").collect()}
    assert got == {(1, 1, "inj-1"), (1, 1, "injection"), (4, 4, "inj-1"), (4, 4, "injection"), (5, 5, "all"), (6, 6, "all"), (7, 13, "xss"), (9, 11, "crypto"), (16, 17, "auth")}
    f = spark.createDataFrame([(1, 1, 4, "INJ-9"), (2, 1, 8, "XSS-1"), (3, 1, 8, "CRY-1"), (4, 1, 10, "CRY-1"), (5, 2, 4, "INJ-1")], "finding_id long, input_id long, line_number int, rule_id string")
    assert {r.finding_id: r.suppressed for r in suppress.split(f, suppress.covered(ls, "input_id"), "input_id").collect()} == {1: True, 2: True, 3: False, 4: True, 5: False}


def test_store_life_cycle(spark):
    def sighting(i, rule, line, at, path="/a", **more):
        return (i, 1, rule, 3, path, line, "CWE-1", None, 0.5, None, "t", "m", datetime(2025, 1, at), more.get("off", False), more.get("why"))

    schema = FINDING + ", at timestamp, suppressed boolean, suppress_reason string"
    scan = lambda rows: spark.createDataFrame(rows, schema)
    when = lambda d: F.lit(f"2025-01-{d:02d}").cast("timestamp")
    one = scan([sighting(1, "A", 3, 1), sighting(2, "B", 5, 1), sighting(3, "C", 6, 1, off=True, why="r")])
    s = store.upsert(spark.createDataFrame([], store.RECORD), store.sightings(one, "at"), one, when(1))
    two = scan([sighting(4, "A", 9, 2), sighting(5, "C", 6, 2)])
    s = store.upsert(s, store.sightings(two, "at"), two, when(2))
    got = {r.rule_id: (r.status, r.line_number, r["count"]) for r in s.collect()}
    assert got == {"A": ("active", 9, 2), "B": ("resolved", 5, 1), "C": ("suppressed", 6, 2)}
    three = scan([sighting(6, "B", 7, 3)])
    s = store.upsert(s, store.sightings(three, "at"), three, when(3))
    assert {r.rule_id: r.status for r in s.collect()} == {"A": "resolved", "B": "active", "C": "suppressed"}
    other = scan([sighting(7, "Z", 1, 4, "/b")])
    s = store.upsert(s, store.sightings(other, "at"), other, when(4))
    assert {r.rule_id: r.status for r in s.collect()} == {"A": "resolved", "B": "active", "C": "suppressed", "Z": "active"}
    assert sum(r.n_records for r in store.summary(s).collect()) == 4 and store.listing(s, "active").count() == 2


SIG = "struct<source_params:map<int,string>,tainted_params:map<int,array<string>>,tainted_returns:map<int,array<string>>,sink_calls:array<struct<category:string,method:string,line:int,arg_from_param:int>>,sanitized_paths:array<struct<param_index:int,sink_category:string,sanitizer:string,line:int>>,is_pure:boolean>"
NODE = f"node_seq long, op string, id string, file_path string, calls array<string>, called_by array<string>, taint_sig {SIG}, content_hash string, last_scan_at timestamp, lang string"


def sig(sinks=(), tainted=None, clean=()):
    return {"source_params": {}, "tainted_params": tainted or {}, "tainted_returns": {}, "sink_calls": [{"category": c, "method": "m", "line": 1, "arg_from_param": p} for c, p in sinks], "sanitized_paths": [{"param_index": p, "sink_category": c, "sanitizer": "s", "line": 1} for c, p in clean], "is_pure": False}


def test_call_graph(spark):
    t = datetime(2025, 1, 1)
    names = "abcdef"
    nodes = [(i, "upsert", f"/x:{n}", "/x", [f"/x:{names[i + 1]}"] if i < 4 else ["/x:a", "/x:none"], None, sig([("sql_query", 0)], None, [("sql_query", 0)] if n == "c" else ()) if n in "ce" else sig((), {0: ["u"]}), n, t, "python") for i, n in enumerate(names)]
    nodes.append((99, "upsert", "/x:a", "/x", ["/x:b"], ["/x:c"], None, "new", datetime(2025, 1, 2), "python"))
    f = callgraph.functions(spark.createDataFrame(nodes, NODE))
    e = callgraph.edges(f)
    assert {(r.caller[-1], r.callee[-1]) for r in e.collect()} == {("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("f", "a"), ("c", "a")}
    start = f.where("id = '/x:e'").select("id")
    assert {(r.caller[-1], r.distance) for r in callgraph.callers(e, start).collect()} == {("d", 1), ("c", 2), ("b", 3), ("a", 4), ("f", 5)}
    assert {(r.caller[-1], r.severity) for r in callgraph.impacted(f, e, start, 1).collect()} == {("d", 4)}
    assert callgraph.stats(f, e).first().asDict() == {"n_functions": 6, "n_files": 1, "n_tainted": 5, "n_edges": 7}
    assert [(r.id[-1], r.content_changed) for r in callgraph.changes(spark.createDataFrame(nodes, NODE)).collect()] == [("a", True)]
    args = {(r.caller[-1], r.callee[-1]) for r in callgraph.tainted_arguments(f, e).collect()}
    assert args == {("d", "e")}


def test_called_names(spark):
    f = texts(spark, (1, "/a.py", "python", "x = foo(a.bar(1), if(2))\nfoo()"), (2, "/a.rb", "ruby", "x.each do |y| puts(z) end"), (3, "/n", "go", None))
    got = {}
    for r in callgraph.called_names(f, "input_id").collect():
        got.setdefault(r.input_id, set()).add(r.name)
    assert got == {1: {"foo", "bar"}, 2: {"each", "puts"}}


FLOWS = [
    ("python", "def f():\n    q = request.args.get('q')\n    sql = \"SELECT \" + q\n    cur.execute(sql)", [("sql_query", 4)]),
    ("python", "def f():\n    q = request.args.get('q')\n    n = int(q)\n    cur.execute('SELECT ' + n)", []),
    ("python", "def f():\n    q = request.args.get('q')\n    cur.execute('SELECT %s', (q,))", []),
    ("python", "os.system(request.args['c'])", [("command_exec", 1)]),
    ("python", "def f():\n    q = request.args.get('q')\n\ndef g():\n    os.system(q)", []),
    ("javascript", "function f(req, res) {\n  const p = req.query.p;\n  fs.readFileSync(\n    '/d/' + p);\n}", [("file_write", 3)]),
    ("go", "func f(w http.ResponseWriter, r *http.Request) {\n\tid := r.URL.Query().Get(\"id\")\n\tdb.Query(\"SELECT \" + id)\n}", [("sql_query", 3)]),
    ("php", "function f() {\n  $q = $_GET['q'];\n  $s = htmlspecialchars($q);\n  echo $s;\n  system($q);\n}", [("command_exec", 5)]),
    ("ruby", "def f\n  q = params[:q]\n  system(\"ls \" + q)\nend", [("command_exec", 3)]),
    ("java", "class A {\n  public void f() {\n    String q = request.getParameter(\"q\");\n    stmt.executeQuery(\"SELECT \" + q);\n  }\n}", [("sql_query", 4)]),
    ("python", "def f():\n    q = request.args.get('q')\n    h = hashlib.sha256(q == 1)\n    x = 1\n    eval(x)", []),
    ("zig", "os.system(request.args)", []),
]


@pytest.mark.parametrize(("lang", "code", "want"), FLOWS)
def test_taint(lang, code, want):
    got = [(s.category, no) for sc in taint.scopes(code, lang) for _, _, s, no, _, _ in taint.track(sc, lang)]
    assert got == want


LONG_CALLS = [
    ("python", "def f():\n    q = request.args.get('q')\n    os.system(\n" + "        'a' +\n" * 40 + "        q\n    )", [("command_exec", 3)]),
    ("python", "def f():\n    q = request.args.get('q')\n    ok = (a or\n      b) and os.system(\n        q\n    )", [("command_exec", 4)]),
    ("javascript", "function f(req, res) {\n  const p = req.query.p;\n  fs.readFile(\n" + "    'x',\n" * 40 + "  );\n  g(p);\n}", []),
    ("python", "def f():\n    q = request.args.get('q')\n    os.system('('\n\ndef g():\n    h(q)", []),
]


@pytest.mark.parametrize(("lang", "code", "want"), LONG_CALLS)
def test_taint_of_long_calls(lang, code, want):
    """A call is joined to its last line or the end of its scope, however many lines that is."""
    got = [(s.category, no) for sc in taint.scopes(code, lang) for _, _, s, no, _, _ in taint.track(sc, lang)]
    assert got == want


def test_long_call_is_not_pure(spark):
    code = "def f(a):\n    q = request.args.get('q')\n    os.system(\n" + "        'a' +\n" * 40 + "        q\n    )"
    rows = graphbuild.signatures(texts(spark, (1, "/a.py", "python", code)), "input_id").collect()
    assert [(r.is_pure, len(r.sink_calls)) for r in rows] == [(False, 1)]


def test_taint_confidence_and_table(spark):
    f = texts(spark, (1, "/a.py", "python", "def f():\n    q = request.args.get('q')\n    a = wrap(q)\n    b = a + 'x'\n    os.system(b)"), (2, "/b.py", "python", None), (3, "/c", None, "x"))
    rows = taint.as_findings(taint.flows(f, "input_id")).collect()
    assert [(r.input_id, r.rule_id, r.scope, round(r.confidence_score, 3), r.confidence) for r in rows] == [(1, "TAINT-command_exec", "f", 0.76, "high")]
    assert [s.var for s in rows[0].steps] == ["q", "a", "b"]
    s = {(r.name, r.start_line, r.end_line) for r in taint.function_scopes(f, "input_id").collect()}
    assert s == {("f", 1, 5)}


def test_catalog_loader(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"sources": [{"id": "s", "category": "user_input", "language": "zig", "pattern": "in\\("}], "sinks": [{"id": "k", "category": "code_eval", "language": "zig", "pattern": "run\\(", "args": [0]}]}))
    c = catalogs.load(p)
    assert [x[2].id for sc in taint.scopes("x = in()\nrun(x)", "zig") for x in taint.track(sc, "zig", c)] == ["k"]


def test_python_tree(spark):
    code = "import subprocess\neval(x)\neval('1')\nsubprocess.run(c, shell=True)\npickle.loads(b)\nopen(p)\nopen('a')\nq = 'SELECT %s' % x\nr = f'DELETE {x}'\ns = f'hello {x}'"
    f = texts(spark, (1, "/a.py", "python", code), (2, "/b.py", "python", "def ("), (3, "/c", "go", "eval(x)"), (4, "/d.py", "python", None))
    assert [(r.line_number, r.rule_id) for r in pyast.findings(f, "input_id").orderBy("line_number").collect()] == [(2, "PYAST-001"), (4, "PYAST-002"), (5, "PYAST-003"), (6, "PYAST-004"), (8, "PYAST-005"), (9, "PYAST-005")]


def test_hints(spark):
    rows = [(i, 1, "INJ-1", 3, "/a", i, "CWE-1", None, 0.5, None, None, None) for i in (1, 2, 3)]
    flows = spark.createDataFrame([(1, 2, "sql_query", 4)], "entry_id long, line_number int, sink_category string, severity int")
    got = sorted((r.kind, r.line_number or 0, r.priority) for r in hints.hints(spark.createDataFrame(rows, FINDING), flows).collect())
    assert got == [("architecture", 0, 2), ("finding", 1, 2), ("finding", 3, 2), ("flow", 2, 1)]


CODE = """def get():
    return request.args.get('q')

def main():
    v = get()
    w = clean(v)
    cur.execute("SELECT " + v)
    n = int(v)
    cur.execute("SELECT " + v)
    helper(get)

def helper(x):
    os.system(request.args['c'])  # os.system(x)
"""


def test_built_graph(spark):
    f = texts(spark, (1, "/a.py", "python", CODE), (2, "/c", "go", None))
    n = graphbuild.nodes(f, "input_id").cache()
    assert {(r.id, tuple(r.calls)) for r in n.collect()} == {("/a.py:get", ()), ("/a.py:helper", ()), ("/a.py:main", ("/a.py:get", "/a.py:helper"))}
    s = {r.id: ([c.category for c in r.sink_calls], r.is_pure) for r in graphbuild.signatures(f, "input_id").collect()}
    assert s == {"/a.py:get": ([], True), "/a.py:main": ([], True), "/a.py:helper": (["command_exec"], False)}
    r = [(x.caller, x.callee, x.source_line, x.sink_line, x.sink_category) for x in graphbuild.tainted_returns(f, "input_id").collect()]
    assert r == [("main", "get", 5, 7, "sql_query")]
    other = graphbuild.nodes(texts(spark, (1, "/a.py", "python", CODE.replace("clean(v)", "other(v)"))), "input_id")
    assert [x.id for x in graphbuild.changed(other, n).collect()] == ["/a.py:main"]


def test_comments(spark):
    f = texts(spark, (1, "/b.js", "javascript", "// eval(x)\nfoo('// no'); /* a\nb */ eval(y)"), (2, "/a.py", "python", "x = '# no' # yes\n\"\"\"# doc\"\"\""), (3, "/c", "go", None), (4, "/d", "*", "# x"))
    assert {(r.input_id, r.start, r.end, r.start_line, r.end_line) for r in comments.spans(f, "input_id").collect()} == {(1, 0, 10, 1, 1), (1, 25, 34, 2, 3), (2, 11, 16, 1, 1)}
    hits = spark.createDataFrame([(1, "A", 1, "eval(x)"), (1, "A", 3, "eval(y)"), (1, "B", 0, "q"), (9, "C", 1, "z"), (1, "D", 1, None)], "input_id long, rule_id string, line_number int, matched_text string")
    assert {(r.rule_id, r.line_number) for r in comments.outside(hits, f, "input_id").collect()} == {("A", 3), ("B", 0), ("C", 1)}


def test_stream(spark, tmp_path):
    from lodesift.streaming import scans

    src = tmp_path / "in"
    src.mkdir()
    event = lambda u, code: json.dumps({"session_id": "s", "hook_event_name": "PreToolUse", "tool_name": "Write", "tool_use_id": u, "tool_input": {"file_path": "/app/x.py", "content": code}})
    stream = lambda: events.read_events(spark, str(src), stream=True)
    (src / "a.json").write_text(event("u1", "yaml.load(f)\nhashlib.md5(x)") + "\n" + event("u1", "yaml.load(f)"))
    scans.start(stream(), RULES, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (src / "b.json").write_text(event("u2", "hashlib.md5(x)"))
    scans.start(stream(), RULES, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.rule_id: (r.status, r["count"]) for r in spark.read.parquet(str(tmp_path / "out/store/1")).collect()}
    assert got["CRY-001"][0] == "active"
    assert spark.read.json(str(tmp_path / "out/ledger/1")).first().n_findings == 1


def test_rule_states_and_languages(spark):
    table = [
        rules.parse({"id": "L-1", "patterns": ["CMD"], "states": [{"kind": "latest", "of": "^USER", "wanted": "root"}]}),
        rules.parse({"id": "B-1", "patterns": ["hit"], "states": [{"kind": "inside", "of": "unsafe \\{"}]}),
        rules.parse({"id": "V-1", "patterns": [{"regex": "foo", "language": "go"}, {"regex": "bar", "confidence": "low", "language": "java"}]}),
    ]
    f = texts(
        spark,
        (1, "/d", "dockerfile", "CMD 0\nUSER root\nCMD 1\nUSER app\nCMD 2\nUSER root"),
        (2, "/r", "rust", "hit\nunsafe {\n  if x { hit }\n  hit\n}\nhit\nunsafe { }\nhit"),
        (3, "/g", "go", "foo\nbar"),
        (4, "/j", "java", "foo\nbar"),
        (5, "/p", "python", "foo\nbar"),
    )
    got = sorted((r.input_id, r.rule_id, r.line_number, r.confidence) for r in rules.apply(f, table, "input_id").collect())
    assert got == [(1, "L-1", 3, "medium"), (2, "B-1", 3, "medium"), (2, "B-1", 4, "medium"), (3, "V-1", 1, "medium"), (4, "V-1", 2, "low")]


def test_whole_scan(spark):
    """Layers agree on a line, a comment and a directive turn findings off, a test file is downgraded, and the decision follows."""
    bad = 'import os\nname = request.args.get("q")\nos.system(name)\n# subprocess.run(c, shell=True)\n# scan:ignore PY-005 -- known\np = tempfile.mktemp()\n'
    f = texts(spark, (1, "/app/a.py", "python", bad), (2, "/app/tests/test_a.py", "python", bad), (3, "/app/ok.py", "python", "x = 1\n"), (4, "/app/n.py", "python", None))
    found = scan.findings(f, "input_id", RULES).cache()
    rows = {(r.input_id, r.rule_id): r for r in found.collect()}
    hit = next(r for (i, _), r in rows.items() if i == 1 and r.line_number == 3 and r.n_merged > 1)
    assert hit.layer == "taint" and hit.confidence_score == 1.0 and hit.severity == 4 and {"taint-analysis", "ast"} <= set(hit.tags)
    assert not any(r.line_number == 4 for r in rows.values())
    off = rows[1, "PY-005"]
    assert off.suppressed and off.suppress_reason == "known" and not hit.suppressed
    assert all(r.severity <= 1 and "test-file" in r.tags and r.confidence_score <= 0.3 for (i, _), r in rows.items() if i == 2)
    d = {r.input_id: r for r in scan.decisions(found, "input_id").collect()}
    assert d[1].blocked and d[1].n_suppressed == 1 and d[1].suppressed_rules == ["PY-005"] and not d[2].blocked and set(d) == {1, 2}
    found.unpersist()


@pytest.mark.parametrize(
    ("language", "declaration", "names"),
    [
        ("python", "def f(self, a, b=(1, 2), *args, **kw):", [("a",), ("b",), ("args",), ("kw",)]),
        ("javascript", "function f({ a, b: c = 1, ...d }, [x], y = g(1, 2), ...z) {", [("a", "c", "d"), ("x",), ("y",), ("z",)]),
        ("typescript", "const f = (a: string, b?: Map<string, number>) => {", [("a",), ("b",)]),
        ("go", "func (s *Server) Get(w http.ResponseWriter, id, name string) error {", [("w",), ("id",), ("name",)]),
        ("java", "public String f(final @A(1) List<String> a, int[] b, String... c) {", [("a",), ("b",), ("c",)]),
        ("php", "function f(?string $a, array &$b = []) {", [("$a",), ("$b",)]),
        ("ruby", "def f(a, b = 1, key: 2, *rest)", [("a",), ("b",), ("key",), ("rest",)]),
        ("rust", "fn f(&self, mut a: Vec<u8>, b: &str) {", [("a",), ("b",)]),
        ("c", "int f(const char *a, unsigned int b[], void) {", [("a",), ("b",)]),
        ("python", "def f():", []),
    ],
)
def test_parameters(language, declaration, names):
    assert taint.parameters(declaration, language) == names


def test_between_functions(spark):
    """An argument reaches a sink in the callee or beyond it; sanitizers, other arguments and clean values don't count."""
    code = """
def query(x, table):
    cur.execute("SELECT a FROM t WHERE b = " + x)

def middle(y):
    z = y.strip()
    query(z, "t")

def outer():
    q = request.args.get("q")
    middle(q)
    query("1", q)
    query(request.form["a"], "t")
    safe = int(q)
    query(safe, "t")

def silent(q):
    middle(q)
"""
    f = texts(spark, (1, "/a.py", "python", code), (2, "/b.py", "python", None), (3, "/c.py", "python", "x = 1"), (4, "/d", None, "x"))
    got = {(r.input_id, r.caller, r.callee, r.argument, r.line_number, r.sink_category, r.sink_line, r.depth) for r in interproc.flows(f, "input_id").collect()}
    assert got == {(1, "outer", "middle", 0, 11, "sql_query", 3, 2), (1, "outer", "query", 0, 13, "sql_query", 3, 1)}
    rows = interproc.as_findings(interproc.flows(f, "input_id")).collect()
    assert {(r.rule_id, r.severity, r.cwe_id, r.confidence_score) for r in rows} == {("INTERPROC-SQL_QUERY", 4, "CWE-89", 0.8)}
    sig = spark.createDataFrame([(1, "f", [("sql_query", 3), ("redirect", 9)]), (2, "g", None)], "k int, id string, sink_calls array<struct<category:string,line:int>>")
    ranges = spark.createDataFrame([(1, 2, 4)], "k int, first int, last int")
    got = {r.id: ([c.line for c in r.sink_calls], [c.line for c in r.suppressed_sinks]) for r in interproc.suppressed_sinks(sig, ranges, "k").collect()}
    assert got == {"f": ([9], [3]), "g": ([], [])}


def test_names_of_catalog_patterns():
    assert pyflow.names_of(r"request\.json\b|request\.get_json\(") == ["request.json", "request.get_json"]
    assert pyflow.names_of(r"subprocess\.(?:call|run)\(") == ["subprocess.call", "subprocess.run"]
    assert pyflow.names_of(r"pickle\.loads?\(") == ["pickle.load", "pickle.loads"]
    assert pyflow.names_of(r"open\(.*\)\.read\(") == [] and pyflow.names_of(r"os\.environ\[?") == ["os.environ"]
    m = lambda k, n: getattr(pyflow.matches(catalogs.CORE, k, n), "id", None)
    assert m("source", "req.args") == m("source", "flask.request.args") == "py.request.args" and m("source", "parser.args") is None
    assert m("sink", "subprocess.run") == "py.subprocess" and m("sink", "task.run") is None and m("sink", "db.cursor.execute") == "py.execute"


PY_FLOWS = [
    ("q = request.args.get('q')\ncur.execute('S' + q)", {("sql_query", 2, 0.95)}),
    ("q = request.args['q']\nw = f(g(q))\nos.system(w)", {("command_exec", 3, 0.7225)}),
    ("q = input()\nif q in OK:\n    os.system(q)\nelse:\n    eval(q)", {("code_eval", 5, 1.0)}),
    ("def f():\n    q = input()\n    if q not in OK:\n        return\n    os.system(q)", set()),
    ("q = input()\nq = 'x'\nos.system(q)", set()),
    ("a, b = input(), 1\nos.system(b)\neval(a)", {("code_eval", 3, 1.0)}),
    ("def f(payload, other):\n    eval(payload)\n    eval(other)", {("code_eval", 2, 0.6)}),
    ("q = input()\ncur.execute('S WHERE a = %s', (q,))", set()),
    ("q = int(input())\ncur.execute(f'S {q}')", set()),
    ("d = {}\nd['a'] = input()\nos.system(d['a'])", {("command_exec", 3, 0.9)}),
    ("for x in request.form:\n    os.system(f'{x}')", {("command_exec", 2, 0.855)}),
    ("with open(input()) as f:\n    pass", {("file_write", 1, 1.0)}),
    ("os.system([x for x in input()][0])", {("command_exec", 1, 0.7695)}),
    ("log.info(os.environ['A'])", set()),
    ("q = input()\ntry:\n    q = 1\nexcept E:\n    eval(q)", {("code_eval", 5, 1.0)}),
    ("if (n := input()):\n    eval(n)", {("code_eval", 2, 1.0)}),
]


@pytest.mark.parametrize(("code", "want"), PY_FLOWS)
def test_python_flows(code, want):
    got = {(f[3].category, f[4], round(f[5], 6)) for f in pyflow.track(code)}
    assert got == want


def test_python_flows_of_files(spark):
    f = texts(spark, (1, "/a.py", "python", PY_FLOWS[0][0]), (2, "/b.py", "python", "q = input()\nos.system(q)\n)("), (3, "/c.py", "python", None), (4, "/d.go", "go", "x"), (5, "/e.py", "python", ""))
    rows = pyflow.flows(f, "input_id")
    assert {(r.input_id, r.rule_id, r.line_number) for r in rows.collect()} == {(1, "TAINT-sql_query", 2), (2, "TAINT-command_exec", 2)}
    text = taint.report(rows).where("input_id = 1").first().report.split("\n")
    assert text[0].startswith("py.request.args -> py.execute (sql_query, 0.95)") and text[1] == "  line 1: from py.request.args" and text[-1] == "  line 2: into py.execute"


def test_fixture_files(spark, tmp_path):
    from lodesift.sources import fixtures

    for rel, text in {
        "python/vulnerable/a_sqli.py": "# Source: our own\n# Expected: INJ-001 (query), OWN-INJ-01\n# OWASP: A03 Injection\nx",
        "python/vulnerable/b.py": "x = 1\n",
        "python/safe/c.py": "# Expected:\nok",
        "go/safe/d.go": "package a\n// Source: s",
        "go/safe/.hidden": "x",
        "go/other/e.go": "x",
    }.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    f = fixtures.load(spark, str(tmp_path)).cache()
    rows = {r["name"]: r for r in f.collect()}
    assert set(rows) == {"a_sqli.py", "b.py", "c.py", "d.go"}
    a = rows["a_sqli.py"]
    assert (a.folder_lang, a.label, a.lang, a.source, a.expected, a.owasp) == ("python", "vulnerable", "python", "our own", ["INJ-001", "OWN-INJ-01"], "A03")
    assert rows["c.py"].expected == [] and rows["d.go"].source == "s"
    found = spark.createDataFrame([(a.path, "INJ-007"), (rows["c.py"].path, "X-1")], "path string, rule_id string")
    assert {r.folder_lang: tuple(r)[1:] for r in fixtures.scorecard(f, found).collect()} == {"python": (2, 1, 1, 1), "go": (0, 0, 1, 0)}


def test_graphs_on_disk(spark, tmp_path):
    from lodesift.sources import graphs

    meta = spark.createDataFrame([("/a", "s1", "2025-01-01T00:00:00Z", 2), ("/b", "s2", "2025-01-01T00:00:00Z", 1), ("/c", "s1", None, 1)], "project_root string, session_id string, last_updated string, version int")
    nodes = spark.createDataFrame([("/a", "x:f", "x", "f", "p", 1, 2, ["x:g"], [], "h", "go", 0), ("/b", "y:f", "y", "f", None, 1, 2, None, None, "h", "go", 0)], "project_root string, id string, file_path string, name string, package string, start_line int, end_line int, calls array<string>, called_by array<string>, content_hash string, language string, finding_count int")
    folder = str(tmp_path / "graphs")
    graphs.save(meta, nodes, folder)
    (tmp_path / "graphs" / "broken.txt").write_text('{"session_id": "s1", "nodes": {')
    got = [(r.project_root, r.id, r.calls) for r in graphs.load(spark, folder, "s1").collect()]
    assert got == [("/a", "x:f", ["x:g"])] and graphs.load(spark, folder, "s9").count() == 0
    callers = spark.createDataFrame([("s", "x:f", 1), ("s", "y:f", 2)], "start string, caller string, distance int")
    files = texts(spark, (1, "x", "go", "code"), (2, "y", "go", "z" * 50))
    assert [(r.caller, r.content) for r in graphs.caller_files(callers, nodes, files, 20).collect()] == [("x:f", "code")]


def test_tree_as_a_table(spark):
    f = texts(spark, (1, "/a.py", "python", "def f(a):\n    return a.b(\n        1)\nx = 2"), (2, "/b.py", "python", ")("), (3, "/c.go", "go", "x"))
    tree = pyast.nodes(f, "input_id").cache()
    rows = {r.node: r for r in tree.collect()}
    assert rows[0].kind == "Module" and rows[0].parent is None and {r.input_id for r in rows.values()} == {1}
    assert all(r.parent is None or r.parent < r.node for r in rows.values())
    assert [(r["name"], r.first_line, r.last_line) for r in pyast.of_kind(tree, "FunctionDef").collect()] == [("f", 1, 3)]
    at = spark.createDataFrame([(1, 3), (1, 4), (1, 9), (2, 1)], "input_id int, line_number int")
    assert {(r.input_id, r.line_number): r.kind for r in pyast.at_line(tree, at, "input_id").collect()} == {(1, 3): "Constant", (1, 4): "Constant", (1, 9): None, (2, 1): None}


def test_texts_of_findings(spark):
    rows = [(1, 7, "R-1", 4, "T", "D", "/a", 3, "m" * 130, "S", "CWE-1", "A01", 0.95), (2, 7, "R-2", None, None, None, "/a", 0, None, "", None, None, 0.0)]
    f = spark.createDataFrame(rows, "finding_id long, entry_id long, rule_id string, severity int, title string, description string, file_path string, line_number int, matched_text string, suggestion string, cwe_id string, owasp_category string, confidence_score double")
    got = {r.finding_id: (r.s, r.d) for r in f.select("finding_id", outputs.short_text().alias("s"), outputs.detail_text().alias("d")).collect()}
    assert got[1][0] == "[!] R-1: T (/a:3)" and got[2][0] == "[?] R-2:  (/a)"
    assert got[1][1].split("\n") == ["[CRITICAL] R-1: T", "  File: /a:3", "  Match: " + "m" * 120 + "...", "  D", "  Fix: S", "  CWE: CWE-1", "  OWASP: A01", "  Confidence: 95%"]
    assert got[2][1].split("\n") == ["[UNKNOWN] R-2: ", "  File: /a"]
    m = outputs.block_messages(f).collect()
    assert len(m) == 1 and "R-1" in m[0].message and "R-2" not in m[0].message


def test_left_hand_sides():
    assert taint.assignment("o.a.b = q", "javascript") == (["o"], "q") and taint.assignment("self.rows[i] = q", "python") == (["rows"], "q")
    assert taint.assignment("const { a, b: c = 1, ...d } = req.body;", "javascript") == (["a", "c", "d"], "req.body")
    assert taint.assignment("let [x, y] = f()", "typescript") == (["x", "y"], "f()") and taint.assignment("$a['k'] = $q;", "php") == (["$a"], "$q")
    assert taint.assignment("if (a.b == c)", "javascript") is None


def test_literals_of_patterns():
    assert rules.literals(r"yaml\.(?:load|unsafe_load)\s*\(") == ("yaml.",)
    assert rules.literals(r"\b(?:os\.system|os\.popen|popen)\s*\(") == ("os.system", "os.popen", "popen")
    assert rules.literals(r"(?i)^USER\s+root\b") == ("user",) and rules.literals(r"a|bcd") == () and rules.literals(r"(?:foo)?x*") == ()
    assert rules.literals(r"x{2,}(?:verify)+\s*=") == ("verify",)
    import re

    for rule in RULES:  # every hit of the cases that fire has one of them
        for p, *_ in rule.patterns:
            assert all(len(t) > 2 and t == t.lower() for t in rules.literals(p)), p
            re.compile(p)


HITS = [
    ("INJ-001", "go", 'q := fmt.Sprintf("SELECT a FROM t WHERE b = %s", x)', 'q := "SELECT a FROM t WHERE b = ?"'),
    ("INJ-001", "python", "q = f'SELECT a FROM t WHERE b = {x}'", "q = 'SELECT a FROM t WHERE b = ?'"),
    ("INJ-001", "ruby", 'User.where("name = #{n}")', 'User.where(name: n)'),
    ("INJ-001", "php", '$q = "SELECT a FROM t WHERE b = $b";', "$q = 'SELECT a FROM t';"),
    ("INJ-002", "python", "subprocess.run(c, shell=True)", "subprocess.run(['ls', d], check=True)"),
    ("INJ-002", "shell", "x=`cat ${f}`", "echo done"),
    ("INJ-002", "java", "Runtime.getRuntime().exec(\"ls \" + d);", "run(d);"),
    ("INJ-004", "java", 'String f = "(uid=" + u;', 'String f = "(uid=1)";'),
    ("INJ-005", "python", "render_template_string(t)", "render_template_string('<b>')"),
    ("INJ-006", "javascript", "doc.evaluate('//u[@n=' + n)", "doc.evaluate('//u')"),
    ("XXE-002", "javascript", "libxmljs.parseXml(x, { noent: true })", "libxmljs.parseXml(x)"),
    ("DESER-001", "java", "new XMLDecoder(in)", "new Decoder(in)"),
    ("DESER-003", "php", "extract($_GET);", "extract($a);"),
]


def test_injection_rules_hit_and_miss(spark):
    f = texts(spark, *[(2 * i + k, "/x", lang, code) for i, (_, lang, *both) in enumerate(HITS) for k, code in enumerate(both)])
    got = {(r.input_id, r.rule_id): r.severity for r in rules.apply(f, RULES, "input_id").collect()}
    for i, (rule, *_) in enumerate(HITS):
        assert (2 * i, rule) in got and (2 * i + 1, rule) not in got, HITS[i]
    assert got[2 * 10, "XXE-002"] == 4  # a severity of the pattern
