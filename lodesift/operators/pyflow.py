"""Taint in Python functions on the syntax tree: expressions carry taint with a decay, statements move it between names.

Every function is walked in order. Sources, sinks and sanitizers are looked up by the last part of the called or read name (``catalogs``
entries are indexed by it) and confirmed by the receiver. Branches are walked apart and joined; a branch behind a membership test of
a name against a fixed collection has that name clean. One pass over files in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.operators import taint
from lodesift.operators.catalogs import CORE, Catalog, Source
from lodesift.session import ship, spread

# What an expression keeps of its operands' confidence.
DECAY = {"binary": 0.95, "call": 0.85, "subscript": 0.9, "interpolation": 0.95, "literal": 0.95}
#: Confidence of a parameter whose name says that it is input.
NAMED_INPUT = 0.6
#: Names of parameters that are taken for input.
INPUT_NAMES = frozenset("request req user_input query_string form_data payload raw_input user_data post_data get_data url_param query_params body".split())
#: Names under which an object of a catalog entry is usually held.
HELD_AS = {
    "request": ("req", "request"),
    "cursor": ("cur", "cursor", "curs"),
    "connection": ("conn", "connection", "db"),
    "db": ("db", "conn", "connection", "database"),
    "session": ("sess", "session"),
    "stmt": ("stmt", "statement"),
}


@dataclass(frozen=True)
class Taint:
    source: Source
    line: int
    confidence: float
    steps: tuple[tuple[int, str], ...] = ()
    clean: frozenset[str] = field(default_factory=frozenset)


State = dict[str, Taint]


def _dotted(node: ast.AST) -> str:
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Subscript):
            node = node.value
        else:
            break
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def names_of(pattern: str) -> list[str]:
    """The dotted names a catalog pattern stands for; alternatives are written out, and what isn't a name (calls through other calls) is left out."""
    forms = [""]
    depth = start = 0
    parts = []
    for i, c in enumerate(pattern):  # alternatives outside of groups
        depth += (c == "(" and pattern[i - 1 : i] != "\\") - (c == ")" and pattern[i - 1 : i] != "\\")
        if c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
    parts.append(pattern[start:])
    if len(parts) > 1:
        return [n for part in parts for n in names_of(part)]
    for lead, some, letter in re.findall(r"(.*?)(?:\(\?:([^()]*)\)|(\w)\?|$)", pattern):
        tails = some.split("|") if some else ["", letter] if letter else [""]
        forms = [f + lead + t for f in forms for t in tails]
    out = []
    for f in forms:
        name = re.sub(r"\\b|\\s\*|\\[(\[]\??$", "", f).replace("\\.", ".").strip(".")
        if re.fullmatch(r"[\w.]+", name):
            out.append(name)
    return out


@lru_cache(maxsize=16)
def _indexed(catalog: Catalog) -> dict[str, dict[str, list[tuple[str, object]]]]:
    """By kind and last part of the name: the receiver an entry wants and the entry."""
    own = catalog.of("python")
    out: dict[str, dict[str, list[tuple[str, object]]]] = {"source": {}, "sink": {}, "sanitizer": {}}
    for kind, entries in (("source", own.sources), ("sink", own.sinks), ("sanitizer", own.sanitizers)):
        for e in entries:
            for name in names_of(e.pattern):
                receiver, _, last = name.rpartition(".")
                out[kind].setdefault(last, []).append((receiver, e))
    return out


def matches(catalog: Catalog, kind: str, name: str) -> object | None:
    """The first entry for a dotted name: its last part is the entry's, and the receiver is the entry's, ends in it, or is a usual name for it."""
    receiver, _, last = name.rpartition(".")
    for wanted, entry in _indexed(catalog)[kind].get(last, ()):
        held = receiver.rpartition(".")[2].lower()
        if not wanted or receiver == wanted or receiver.endswith("." + wanted) or held in HELD_AS.get(wanted.lower(), ()) or (held and held.endswith("_" + wanted.lower())):
            return entry
    return None


class _Walk:
    def __init__(self, scope: str, catalog: Catalog):
        self.scope, self.catalog = scope, catalog
        self.flows: list[tuple] = []
        self.returns: list[Taint] = []

    def best(self, nodes: Iterable[ast.AST | None], state: State, keep: float) -> Taint | None:
        """The surest taint of some expressions, decayed; ties by source and line."""
        found = [t for n in nodes if n is not None and (t := self.of(n, state)) is not None]
        if not found:
            return None
        t = min(found, key=lambda x: (-x.confidence, x.line, x.source.id))
        return replace(t, confidence=t.confidence * keep)

    def of(self, e: ast.AST, state: State) -> Taint | None:
        """The taint of an expression; calls in it are tested as sinks."""
        if isinstance(e, ast.Name):
            return state.get(e.id)
        if isinstance(e, ast.Call):
            return self.call(e, state)
        if isinstance(e, (ast.Attribute, ast.Subscript)):
            inside = self.of(e.slice, state) if isinstance(e, ast.Subscript) else None
            known = matches(self.catalog, "source", _dotted(e))
            if known is not None:
                return Taint(known, e.lineno, 1.0, ((e.lineno, _dotted(e)),))  # type: ignore[arg-type]
            t = self.best([e.value], state, DECAY["subscript"] if isinstance(e, ast.Subscript) else 1.0)
            return t or (replace(inside, confidence=inside.confidence * DECAY["subscript"]) if inside else None)
        if isinstance(e, ast.BinOp):
            return self.best([e.left, e.right], state, DECAY["binary"])
        if isinstance(e, ast.JoinedStr):
            return self.best([v.value for v in e.values if isinstance(v, ast.FormattedValue)], state, DECAY["interpolation"])
        if isinstance(e, (ast.List, ast.Tuple, ast.Set)):
            return self.best(e.elts, state, DECAY["literal"])
        if isinstance(e, ast.Dict):
            return self.best([*e.keys, *e.values], state, DECAY["literal"])
        if isinstance(e, ast.BoolOp):
            return self.best(e.values, state, 1.0)
        if isinstance(e, ast.IfExp):
            self.of(e.test, state)
            return self.best([e.body, e.orelse], state, 1.0)
        if isinstance(e, ast.NamedExpr):
            t = self.of(e.value, state)
            self.assign(e.target, t, state)
            return t
        if isinstance(e, (ast.Await, ast.Starred, ast.UnaryOp, ast.FormattedValue, ast.Yield, ast.YieldFrom)):
            inner = e.operand if isinstance(e, ast.UnaryOp) else e.value
            t = self.best([inner], state, 1.0)
            return None if isinstance(e, ast.UnaryOp) else t
        if isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            inner_state = dict(state)
            for g in e.generators:
                self.assign(g.target, self.best([g.iter], inner_state, DECAY["subscript"]), inner_state)
                for test in g.ifs:
                    self.of(test, inner_state)
            return self.best([e.key, e.value] if isinstance(e, ast.DictComp) else [e.elt], inner_state, DECAY["literal"])
        if isinstance(e, ast.Compare):
            for x in (e.left, *e.comparators):
                self.of(x, state)
        return None

    def call(self, e: ast.Call, state: State) -> Taint | None:
        name = _dotted(e.func)
        values = [*e.args, *[k.value for k in e.keywords]]
        taints = [self.of(a, state) for a in values]
        receiver = self.of(e.func.value, state) if isinstance(e.func, ast.Attribute) else None
        sink = matches(self.catalog, "sink", name)
        if sink is not None:
            bound = sink.category == "sql_query" and len(e.args) > 1 and isinstance(e.args[0], ast.Constant)  # type: ignore[attr-defined]
            at = range(len(values)) if -1 in sink.args or not sink.args else [i for i in sink.args if i < len(values)]  # type: ignore[attr-defined]
            hit = [t for i in at if (t := taints[i]) is not None and sink.category not in t.clean]  # type: ignore[attr-defined]
            if hit and not bound:
                t = min(hit, key=lambda x: (-x.confidence, x.line, x.source.id))
                if not (t.source.category == "env_var" and sink.category == "log_output"):  # type: ignore[attr-defined]
                    self.flows.append((t.source, t.line, sink, e.lineno, t.confidence, (*t.steps, (e.lineno, name))))
        known = matches(self.catalog, "source", name) or (isinstance(e.func, ast.Attribute) and matches(self.catalog, "source", _dotted(e.func.value)))
        if known:  # of what a source is asked for, all is foreign
            return Taint(known, e.lineno, 1.0, ((e.lineno, name),))  # type: ignore[arg-type]
        some = [t for t in (*taints, receiver) if t is not None]
        if not some:
            return None
        t = min(some, key=lambda x: (-x.confidence, x.line, x.source.id))
        cleaner = matches(self.catalog, "sanitizer", name)
        if cleaner is not None:
            return replace(t, clean=t.clean | set(cleaner.neutralizes))  # type: ignore[attr-defined]
        return replace(t, confidence=t.confidence * DECAY["call"])

    def assign(self, target: ast.AST, t: Taint | None, state: State) -> None:
        """A name gets or loses taint; a part of an object only adds to it."""
        if isinstance(target, ast.Name):
            if t is None:
                state.pop(target.id, None)
            else:
                state[target.id] = replace(t, steps=(*t.steps, (target.lineno, target.id)))
        elif isinstance(target, (ast.Tuple, ast.List)):
            for x in target.elts:
                self.assign(x, t, state)
        elif isinstance(target, ast.Starred):
            self.assign(target.value, t, state)
        elif isinstance(target, (ast.Attribute, ast.Subscript)) and t is not None:
            root = _dotted(target).split(".")[0]
            if root and (root not in state or state[root].confidence < t.confidence):
                state[root] = replace(t, steps=(*t.steps, (target.lineno, root)))

    def checked(self, test: ast.AST) -> tuple[set[str], set[str]]:
        """The names a test shows to be one of a fixed set where it holds, and where it doesn't."""
        if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
            a, b = self.checked(test.operand)
            return b, a
        if isinstance(test, ast.BoolOp):
            both = [self.checked(v) for v in test.values]
            yes, no = set().union(*(a for a, _ in both)), set().union(*(b for _, b in both))
            return (yes, set()) if isinstance(test.op, ast.And) else (set(), no)
        if isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.left, ast.Name):
            fixed = isinstance(test.comparators[0], (ast.Name, ast.Attribute, ast.List, ast.Tuple, ast.Set, ast.Dict))
            if fixed and isinstance(test.ops[0], ast.In):
                return {test.left.id}, set()
            if fixed and isinstance(test.ops[0], ast.NotIn):
                return set(), {test.left.id}
        return set(), set()

    def branch(self, body: list[ast.stmt], state: State, clean: set[str]) -> State | None:
        """The state behind a branch in which some names are clean; None if it doesn't go on behind it."""
        own = {n: t for n, t in state.items() if n not in clean}
        self.body(body, own)
        return None if body and isinstance(body[-1], (ast.Return, ast.Raise, ast.Continue, ast.Break)) else own

    def join(self, state: State, branches: list[State | None]) -> None:
        ways = [b for b in branches if b is not None]
        state.clear()
        for b in ways:
            for n, t in b.items():
                if n not in state or t.confidence > state[n].confidence:
                    state[n] = t

    def body(self, statements: list[ast.stmt], state: State) -> None:
        for s in statements:
            if isinstance(s, ast.Assign):
                if isinstance(s.value, (ast.Tuple, ast.List)) and len(s.targets) == 1 and isinstance(s.targets[0], (ast.Tuple, ast.List)) and len(s.value.elts) == len(s.targets[0].elts):
                    for x, t in zip(s.targets[0].elts, [self.of(v, state) for v in s.value.elts], strict=True):
                        self.assign(x, t, state)
                else:
                    t = self.of(s.value, state)
                    for target in s.targets:
                        self.assign(target, t, state)
            elif isinstance(s, ast.AnnAssign) and s.value is not None:
                self.assign(s.target, self.of(s.value, state), state)
            elif isinstance(s, ast.AugAssign):
                t = self.best([s.target, s.value], state, DECAY["binary"])
                if t is not None:
                    self.assign(s.target, t, state)
            elif isinstance(s, ast.Expr):
                self.of(s.value, state)
            elif isinstance(s, ast.Return) and s.value is not None:
                t = self.of(s.value, state)
                if t is not None:
                    self.returns.append(t)
            elif isinstance(s, ast.If):
                self.of(s.test, state)
                yes, no = self.checked(s.test)
                self.join(state, [self.branch(s.body, state, yes), self.branch(s.orelse, state, no)])
            elif isinstance(s, (ast.For, ast.AsyncFor)):
                self.assign(s.target, self.best([s.iter], state, DECAY["subscript"]), state)
                self.join(state, [dict(state), self.branch(s.body, state, set())])
                self.body(s.orelse, state)
            elif isinstance(s, ast.While):
                self.of(s.test, state)
                self.join(state, [dict(state), self.branch(s.body, state, set())])
                self.body(s.orelse, state)
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                for item in s.items:
                    t = self.of(item.context_expr, state)
                    if item.optional_vars is not None:
                        self.assign(item.optional_vars, t, state)
                self.body(s.body, state)
            elif isinstance(s, ast.Try):
                before = dict(state)
                self.body(s.body, state)
                self.body(s.orelse, state)
                self.join(state, [dict(state), *[self.branch(h.body, before, set()) for h in s.handlers]])
                self.body(s.finalbody, state)
            elif isinstance(s, ast.Match):
                t = self.of(s.subject, state)
                for case in s.cases:
                    for n in ast.walk(case.pattern):
                        if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name and t is not None:
                            state[n.name] = t
                self.join(state, [dict(state), *[self.branch(c.body, state, set()) for c in s.cases]])
            elif isinstance(s, (ast.Raise, ast.Assert, ast.Delete)):
                for n in ast.iter_child_nodes(s):
                    self.of(n, state)


def scopes(tree: ast.Module) -> Iterator[tuple[str, list[ast.stmt], list[str]]]:
    """Name, body and parameters of every function, and the statements outside of them."""
    top = [s for s in tree.body if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = n.args
            yield n.name, n.body, [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else []))]
    if top:
        yield "__top_level__", top, []


def track(source: str, catalog: Catalog = CORE) -> list[tuple] | None:
    """The flows of a file: scope, source, its line, sink, its line, confidence, steps; None if it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out = []
    for name, body, params in scopes(tree):
        walk = _Walk(name, catalog)
        seeds = {p: Taint(Source(f"py.param.{p}", "user_input", "python", ""), body[0].lineno, NAMED_INPUT, ((body[0].lineno, p),)) for p in params if p.lower() in INPUT_NAMES}
        walk.body(body, seeds)
        out += [(name, *f) for f in walk.flows]
    return sorted(set(out), key=lambda f: (f[4], f[2], f[0], f[1].id, f[3].id))


def flows(files: DataFrame, key: str, catalog: Catalog = CORE) -> DataFrame:
    """``key`` and ``taint.FLOW`` of every Python file (``key, lang, content``); those that don't parse go through the fold over lines (``taint``)."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]
    step = pa.list_(pa.struct([("line", pa.int32()), ("var", pa.string())]))
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), step]
    names = [c.split()[0] for c in taint.FLOW.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = track(text, catalog)
                if found is None:
                    found = [(sc.name, *f) for sc in taint.scopes(text, "python") for f in taint.track(sc, "python", catalog)]
                rows += [(k, scope, f"TAINT-{sink.category}", src.id, at, sink.id, no, sink.category, sink.severity, sink.cwe, c, [{"line": i, "var": v} for i, v in steps]) for scope, src, at, sink, no, c, steps in found]
            cols = list(zip(*rows, strict=True)) or [()] * 12
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]], [key, *names])

    return spread(files.where((F.col("lang") == "python") & F.col("content").isNotNull()).select(key, "content")).mapInArrow(run, f"{key} {kind}, {taint.FLOW}")
