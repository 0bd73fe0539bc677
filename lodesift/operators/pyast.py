"""Checks on the syntax tree of Python files."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.session import ship, spread

SCHEMA = "line_number int, rule_id string, severity int, confidence string, cwe_id string, title string, matched_text string"
# Calls that run text, and loaders of foreign objects.
_RUNS = {"eval": "CWE-95", "exec": "CWE-95", "os.system": "CWE-78"}
_LOADS = ("pickle.load", "pickle.loads")
_SQL = re.compile(r"\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b", re.I)
_SUBPROCESS = re.compile(r"^subprocess\.(?:Popen|call|run|check_output|check_call)$")


def _name(node: ast.expr) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else ""


def _literal(node: ast.expr) -> bool:
    return isinstance(node, ast.Constant) or (isinstance(node, (ast.List, ast.Tuple)) and all(_literal(x) for x in node.elts))


def check(source: str) -> list[tuple[int, str, int, str, str, str, str]]:
    """The findings of one file, in order of place; none if it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = source.split("\n")
    out = []

    def add(node: ast.AST, rule: str, severity: int, confidence: str, cwe: str, title: str) -> None:
        text = lines[node.lineno - 1].strip() if node.lineno <= len(lines) else ""  # type: ignore[attr-defined]
        out.append((node.lineno, f"PYAST-{rule}", severity, confidence, cwe, title, text[:120]))  # type: ignore[attr-defined]

    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            name = _name(node.func)
            variable = bool(node.args) and not _literal(node.args[0])
            if name in _RUNS and variable:
                add(node, "001", 4, "high", _RUNS[name], f"{name}() with a variable argument")
            if _SUBPROCESS.match(name) and variable and any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords):
                add(node, "002", 4, "high", "CWE-78", f"Shell injection via {name}")
            if name in _LOADS and variable:
                add(node, "003", 4, "high", "CWE-502", f"Unsafe deserialization via {name}")
            if name == "open" and variable:
                add(node, "004", 3, "medium", "CWE-22", "Path traversal via open() with variable path")
        elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod) and isinstance(node.left, ast.Constant) and isinstance(node.left.value, str) and _SQL.search(node.left.value):
            add(node, "005", 4, "high", "CWE-89", "SQL injection via string % formatting")
        elif isinstance(node, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in node.values) and any(isinstance(v, ast.Constant) and _SQL.search(str(v.value)) for v in node.values):
            add(node, "005", 4, "high", "CWE-89", "SQL injection via f-string interpolation")
    return sorted(out)


def findings(files: DataFrame, key: str) -> DataFrame:
    """The tree findings of the Python files (``key, lang, content``); files that don't parse have none."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]
    types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["line_number", "rule_id", "severity", "confidence", "cwe_id", "title", "matched_text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *f) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in check(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]], [key, *names])

    return spread(files.where((F.col("lang") == "python") & F.col("content").isNotNull()).select(key, "content")).mapInArrow(run, f"{key} {kind}, {SCHEMA}").withColumn("tags", F.array(F.lit("ast")))


NODES = "node int, parent int, kind string, name string, first_line int, first_column int, last_line int, last_column int"


def nodes(files: DataFrame, key: str) -> DataFrame:
    """``key`` and ``NODES``: the syntax tree of every Python file as a table, numbered from 0 (the module) in order of place; files that don't parse have none.

    ``name`` is that of functions, classes, names, attributes and arguments. Lines are counted from 1, columns (in bytes) from 0; parts without place have null.
    """
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in NODES.split(", ")]

    def rows_of(k: object, source: str) -> Iterator[tuple]:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                stack: list[tuple[ast.AST, int | None]] = [(ast.parse(source), None)]
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        n = 0
        while stack:
            node, parent = stack.pop()
            if isinstance(node, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
                continue
            place = [getattr(node, a, None) for a in ("lineno", "col_offset", "end_lineno", "end_col_offset")]
            yield (k, n, parent, type(node).__name__, next((v for a in ("name", "id", "attr", "arg") if isinstance(v := getattr(node, a, None), str)), None), *place)
            stack += [(c, n) for c in reversed(list(ast.iter_child_nodes(node)))]
            n += 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows_of(k, t)]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]], [key, *names])

    return spread(files.where((F.col("lang") == "python") & F.col("content").isNotNull()).select(key, "content")).mapInArrow(run, f"{key} {kind}, {NODES}")


def of_kind(tree: DataFrame, *kinds: str) -> DataFrame:
    """The nodes of some kinds."""
    return tree.where(F.col("kind").isin(*kinds))


def at_line(tree: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """For each of ``places`` (``key, line_number``) the innermost node over its line: the last that begins at or before it and ends at or behind it.

    The nodes of a file come as one array to its places, so the join is by file only.
    """
    per_file = tree.where("first_line IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node", "kind", "name", "first_line", "last_line"))).alias("__nodes"))
    over = F.filter("__nodes", lambda n: F.col("line_number").between(n["first_line"], n["last_line"]))
    return places.join(per_file, key, "left").withColumn("__n", F.get(over, F.size(over) - 1)).select(*places.columns, F.col("__n.node").alias("node"), F.col("__n.kind").alias("kind"), F.col("__n.name").alias("name"))
