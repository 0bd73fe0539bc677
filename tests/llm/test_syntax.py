"""Grammars, and the verdicts made of them."""

import pytest

from lodesift.llm import syntax
from lodesift.llm.grammars import LANGUAGES, parses

GOOD = {
    "python": ["x = 1\n", "async def f(a, *, b=1) -> int:\n    return await a\n", "\ufeffx = 1\r\n"],
    "javascript": [
        "import a, { b as c } from 'x'; export default class { #p = 1; static { f() } get x() { return this.#p } }",
        "const t = `a ${b + `n ${c}`}`; const r = /[/\\]]+/gi.test(s) ? a : b",
        "for (const [k, v] of Object.entries(o)) { if (k) continue; else break }",
        "a = b\n++c\nlet z = a\n  .b()",
        "const note = `\n<<<<<<< ours\n=======\n>>>>>>> theirs\n`;",
        "label: while (1) { do { x++ } while (x < 5); break label }",
        "x = { a, b() {}, get c() { return 1 }, async d() {}, [e]: 1, 'f': 2, ...g }",
    ],
    "typescript": [
        "interface A<T extends B = C> { a: string; b?: number; c(x: number): void; readonly [k: string]: any }",
        "type M = { [K in keyof T]?: T[K] }; type C2 = A extends B ? C : D; let x: Record<string, Map<string, number>> = {};",
        "export abstract class F<T> extends B<T> implements I { constructor(private a: string) { super() } abstract z(): void; }",
        "function f(this: Window, a?: string, ...r: number[]): asserts a is string { return a as any }",
        "enum E { A = 1, B }\ndeclare module 'x' { export const y: number; }\nlet d = e as unknown as F, h = g!.i;",
    ],
    "go": [
        "package main\nimport ( f \"fmt\"; _ \"x\" )\ntype T struct { a, b int `json:\"a\"`; *E }\nfunc (t *T) M(a int, c ...string) (r int, err error) { if err := f(); err != nil { return 0, err }\n return }\n",
        "package m\nfunc G[T any](x T) T { switch v := x.(type) { case int: f(v); default: }\n select { case v := <-c: f(v); default: }\n return x }\n",
    ],
    "java": [
        "package a; import java.util.*; @A(x = {1}) public final class F<T extends B & C> extends D<Map<String, Integer>> { int[] a = {1}; static { f(); } <U> List<? extends U> m(U u) throws E { return u == null ? (List<U>) q : new ArrayList<U>() {}; } }",
        "class A { void f() { int k = switch (d) { case A, B -> 1; case C -> { yield 2; } default -> throw new E(); }; Runnable r = () -> {}; for (String s : l) g(String::valueOf); if (o instanceof String s && s.length() > 3) {} } }",
        "record P(int x) { P {} } enum E { A, B(1) { void x() {} }; E() {} } @interface Q { String v() default \"\"; }",
    ],
    "php": ["<?php namespace A\\B; use C\\{D, E as F}; abstract class X extends Y implements Z { public function __construct(private ?string $a = 'x', int|string ...$r) {} }", "<?php if ($a): ?>x<?php else: ?>y<?php endif; $f = fn($x) => $x * 2; $g = match(true) { 1, 2 => 'a', default => throw new \\E() };"],
    "ruby": ["class A < B\n  def m(a, b = 1, *r, k: 2, &blk)\n    x.each do |v, (w)|\n      puts \"#{v[:a]}\" if v\n    end\n  rescue E => e\n    log e\n  ensure\n    y\n  end\nend\n", "s = <<~EOS\n  a #{b} {\nEOS\ncase x\nwhen 1 then a\nelse b\nend\nh = { a: 1, 'b' => %w[c d] }\n", "=begin\n<<<<<<< ours\n=end\nx = 1\n"],
    "c": ["#include <a.h>\n#if 0\nint f(void) {\n#endif\ntypedef struct n { int a : 3; struct n *x; } n_t;\nint main(int argc, char **argv) { for (int i = 0; i < 3; i++) { f((int)x, sizeof(int)); } return (a), b; }\n", "int (*fp)(int), a[2][3] = { [1] = {1} };\nenum c { A = 1, B, };\n"],
    "shell": ["f() {\n  if [ -z \"$1\" ]; then echo x >&2; fi\n  for g in /d/*; do echo \"$g\"; done\n}\n", "cat <<'EOT'\n<<<<<<< ours\nif then (\nEOT\ncase $x in a|b) y ;; *) z; esac\n", "x=$((1 + (2*3))); [[ $a =~ ^x$ ]] && b || c"],
    "json": ['{"a": [1, 2.5e3, null, true, "\\u00e9"]}', "1"],
    "yaml": ["a: 1\nb:\n  - x\n  - y: 1\n    z: 2\nc: {d: 1, e: [1, 2]}\n", "a: |\n  text: x\nb: >-\n  y\n", "---\na: &x b\nc: *x\n...\n---\nd"],
}
BAD = {
    "python": ["def f(:\n  pass", "x = \u201ca\u201d", "print 1"],
    "javascript": ["const a = ;", "f(a b)", "if (a { b }", "let x = `abc ${d", "class { }", "<<<<<<< HEAD\na\n=======\n", "const x", "else {}"],
    "typescript": ["interface A { a: }", "let x: = 1", "function f(a: string {", "var note = \"unfinished;\nx"],
    "go": ["func f() {}", "package m\nx := 1", "package m\nfunc f() { if x\n{\n} }", "package m\nfunc f() { x = [1, 2] }", "package m\nfunc f() {\n    ... rest of the function unchanged ...\n}"],
    "java": ["class X { void f() { int x = ; } }", "class X {", "const x = 1;", "class X { void f() { else {} } }"],
    "php": ["<?php $x = ;", "<?php if ($x) {", "<?php $a b;", "<?php class { }"],
    "ruby": ["def f\n  x", "end", "x = [1, 2", "foo(1, 2", "x = 1 +", "1 2"],
    "c": ["int main() { foo() }", "int main() {", "#inclde <x>\nint x;", "#if 1\nint x;", "int f() { return 1 2; }"],
    "shell": ["if true; then\necho", "fi", "f() {", "echo 'abc", "echo $(foo", "while true; do done"],
    "json": ["{'a': 1}", '{"a": 1,}', "// c\n{}", '{"a": NaN}', "{} x"],
    "yaml": ["a: b: c", "a: 1\n b: 2", "a: \"x", "a: [1, 2", "a:\n\tb: 1", "a: 1\n- b", "<<<<<<< HEAD\na: 1\n=======\n"],
}


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, v in GOOD.items() for t in v])
def test_accepts(lang, text):
    assert parses(text, lang)


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, v in BAD.items() for t in v])
def test_rejects(lang, text):
    assert not parses(text, lang)


def test_every_language_is_covered():
    assert set(GOOD) == set(BAD) == set(LANGUAGES) == set(syntax.SIGNS)


@pytest.mark.parametrize("lang", LANGUAGES)
def test_cut_brackets_never_parse(lang):
    """Without its last closing bracket or word no text of brackets parses."""
    for text in GOOD[lang]:
        cut = text.rstrip()
        if cut[-1] in "})]" and lang != "shell":
            assert not parses(cut[:-1], lang)


def test_long_and_odd_texts():
    assert parses("x = 1;\n" * 20_000, "javascript")
    assert not parses("(" * 5000, "javascript")
    assert parses("if (a) b(); " + "else if (c) d(); " * 1500, "javascript")
    assert parses("x = " + "a ? b : " * 1500 + "c", "javascript")
    assert not parses("[" * 200_000, "json")
    for lang in LANGUAGES:
        parses("\x00\ud7ff" + "é" * 100, lang)


def test_no_cap_on_depth_and_digits():
    assert parses("[" * 50_000 + "]" * 50_000, "json") and not parses("[" * 50_000 + "]" * 49_999, "json")
    assert parses('{"a": ' * 20_000 + "NaN" * 0 + "1" + "}" * 20_000, "json") and not parses('{"a": ' * 20_000 + "NaN" + "}" * 20_000, "json")
    assert parses("7" * 6000, "json") and parses("x = " + "7" * 6000, "python") and parses("1e400", "json") and not parses("01", "json")
    assert parses("if (a) b(); " + "else if (c) d(); " * 30_000, "javascript")
    assert parses("x = " + "a ? b : " * 30_000 + "c;", "javascript")


def test_accepting():
    py = "import os\n\ndef f(x):\n    return [y for y in x if y is not None]\n"
    assert syntax.accepting(py)[0] == "python" and "go" not in syntax.accepting(py)
    assert syntax.accepting("}{ <<<< '") == []
    assert set(syntax.accepting('{"a": 1}')) >= {"json", "yaml"}
    assert set(syntax.ranking(py)) == set(LANGUAGES) and syntax.ranking(py)[0] == "python"


def test_verdicts_and_report(spark):
    rows = [(1, "r", "json", "{}", 1), (2, "r", "json", "{", 1), (3, "r", "go", "import os\nprint(os)\nif x:\n    y = None\n", 1), (4, "r", "json", None, 1), (5, "r", "json", " \n", 1), (6, "r", "sql", "{", 1), (7, None, "json", "{}", 1), (7, None, "json", "{}", 1), (8, "r", None, "{}", 1)]
    files = spark.createDataFrame(rows, "input_id long, repo string, lang string, content string, valid int")
    v = syntax.verdicts(syntax.parsed(files))
    assert sorted((r.input_id, r.valid, r.verdict, r.parsed_as) for r in v.collect() if r.input_id != 3) == [(1, True, "valid", "json"), (2, False, "corrupt", None), (7, True, "valid", "json"), (7, True, "valid", "json")]
    assert [(r.valid, r.verdict, r.parsed_as) for r in v.where("input_id = 3").collect()] == [(False, "wrong_extension", "python")]
    rep = {(r.repo, r.lang): (r.n_files, r.n_invalid, r.invalid_rate) for r in syntax.report(v).collect()}
    assert rep == {("r", "json"): (2, 1, 0.5), ("r", "go"): (1, 1, 1.0), (None, "json"): (2, 0, 0.0)}
    assert syntax.verdicts(syntax.parsed(files.limit(0))).collect() == []
    clash = syntax.parsed(files.where("input_id = 1").selectExpr("input_id", "repo", "lang", "content", "'x' AS accepted", "1 AS valid"))
    assert [(r.valid, "json" in r.accepted) for r in clash.collect()] == [(1, True)]


def test_written_files(spark):
    hooks = spark.createDataFrame([(1, 1, "c", "Write", {"content": "{}"}), (2, 1, "c", "Edit", {"content": "{}"}), (3, None, "c", "Write", {"content": "{}"}), (4, 2, "c", "Write", None)], "input_id long, entry_id long, cwd string, tool_name string, tool_input struct<content:string>")
    ledger = spark.createDataFrame([(1, " Json ", "k"), (2, None, "k")], "entry_id long, lang string, cwd string")
    got = [tuple(r) for r in syntax.written_files(hooks, ledger).collect()]
    assert [r[:3] for r in got] == [(1, "c", "json")] and "json" in got[0][3]


C_BRANCHES = [
    ("#ifdef A\nint f(void) {\n#else\nint f(int x) {\n#endif\nreturn 1; }\n", True),
    ("#ifdef A\nint x;\n#else\nint f( {\n#endif\n", False),
    ("#if A\nint x;\n#elif B\nint x\n#else\nint y;\n#endif\n", False),
    ("#if A\n#if B\nint x;\n#else\nint f( {\n#endif\n#else\nint y;\n#endif\n", False),
    ("#if 0\nint f( {\n#else\nint x;\n#endif\n", True),
    ("#if 1\nint x;\n#else\nint f( {\n#endif\n", True),
    ("#ifdef P\nstruct s {\n#endif\nint x;\n#ifdef A\nint y;\n#else\nint z;\n#endif\n#ifdef P\n};\n#endif\n", True),
    ("#if 0\n#if A\nint f( {\n#else\n((\n#endif\n#endif\nint x;\n", True),
]


@pytest.mark.parametrize(("text", "valid"), C_BRANCHES)
def test_every_branch_of_c(text, valid):
    assert parses(text, "c") is valid
