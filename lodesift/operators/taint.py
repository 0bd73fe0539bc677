"""Taint inside functions: an ordered fold over the statements of each scope.

The state is a map of variables with strong updates, which no window expresses; the fold runs per file over
Arrow batches, without a shuffle. Where several tainted variables meet in an expression, the surest one counts, then the first by
name, so that results don't depend on any order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.operators.catalogs import CORE, Catalog, Sink, Source
from lodesift.session import ship, spread

#: Decay for a call that is neither known nor a sanitizer.
UNKNOWN_CALL = 0.8
# What an operation keeps of taint; the first that matches counts: pattern, factor (0 stops it).
PROPAGATION = (
    (r"(?i)(hashlib\.\w+|\.hash\(|sha[0-9]+|md5|bcrypt\.hash|crypto\.createHash|digest\(\)|hexdigest\(\))", 0.0),
    (r"(?i)(encrypt|cipher\.|\.seal\(|aes\.|rsa\.|gpg\.|nacl\.)", 0.0),
    (r"(==|!=|<=|>=|\.equals\(|\.compareTo\(|\.compare\()", 0.0),
    (r"""(fmt\.Sprintf|fmt\.Fprintf|\.format\(|f"[^"]*\{|f'[^']*\{|String\.format|sprintf|printf|%[sdvqxf])""", 0.95),
    (r"`[^`]*\$\{", 0.95),
    (r"""(\+\s*["']|["']\s*\+|\.\.\s*["']|["']\s*\.\.|\.concat\()""", 0.95),
    (r"(?i)\.(strip|trim|lower|upper|replace|substring|substr|slice|split|chomp|squeeze|downcase|upcase|capitalize|title|lstrip|rstrip|trimStart|trimEnd|trimLeft|trimRight|padStart|padEnd)\(", 0.9),
    (r"(?i)(\.encode\(|\.decode\(|base64\.\w+|url\.QueryEscape|encodeURIComponent|encodeURI|urllib\.quote|CGI\.escape|URI\.encode|htmlspecialchars)", 0.9),
    (r"(?i)(str\(|int\(|float\(|bool\(|String\(|Integer\.\w+|Float\.\w+|Number\(|\.toString\(|\.to_s|\.to_i|\.to_f|strconv\.\w+|\.String\(\)|\.Int\(\)|\.Value\(\))", 0.85),
    (r"(?i)(\.append\(|\.push\(|\.add\(|\.insert\(|\.extend\(|\.join\(|\.concat\(|strings\.Join|\.unshift\(|\.prepend\()", 0.8),
    (r"[\+\-\*/%]\s*\d|\d\s*[\+\-\*/%]", 0.0),
)
# Signs of a statement with bound parameters.
_BOUND = re.compile(r"""\$\d+|(?:^|[^\\])\?|:\w+|%s|\.where\s*\(\s*['"{]|\.andWhere\s*\(|\.orWhere\s*\(""")
_SQL = re.compile(r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|MERGE)\b")
_CALL = re.compile(r"[A-Za-z_][\w.]*\s*\(")
_NO_ASSIGNMENT = re.compile(r"^(?://|#|/\*|\*|return |if |for |while |switch |case |func |def |class |import |from |package )")
# Assignments by language, written for this fold; the first form that matches counts.
_ASSIGNMENT = (
    (("go",), re.compile(r"^([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*:=\s*(.+)$")),
    (("java", "csharp"), re.compile(r"^(?:final\s+)?[A-Z][\w<>,\s\[\]]*?\s+([A-Za-z_]\w*)\s*=(?!=)\s*(.+)$")),
    ((), re.compile(r"^(?:export\s+)?(?:var|let|const|mut)\s+([A-Za-z_$][\w$]*)\s*(?::\s*[\w.<>\[\]|, ]+?)?\s*=(?!=)\s*(.+)$")),
    (("php",), re.compile(r"^(\$[A-Za-z_]\w*)\s*\.?=(?!=)\s*(.+)$")),
    ((), re.compile(r"^([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*[+\-*/]?=(?!=)\s*(.+)$")),
)
_PART_ASSIGNED = re.compile(r"^(?:self\.|this\.|\$this->)?(\$?[A-Za-z_]\w*)(?:(?:\.|->)\w+|\[[^\]]*\])+\s*[+.]?=(?!=)\s*(.+)$")
_DESTRUCTURED = re.compile(r"^(?:export\s+)?(?:var|let|const)\s*[{\[](.*?)[}\]]\s*(?::\s*[^=]+)?=(?!=)\s*(.+)$")
# Words that start no method of a class.
_NO_METHOD = frozenset("if for while switch catch return else do try function new typeof with synchronized using lock foreach elseif".split())
_BRACED = {
    "go": re.compile(r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\("),
    "javascript": re.compile(r"^(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(\w+)?\s*\(|^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=]*=>|\w+\s*=>)|^(?:router|app)\.(get|post|put|delete|patch|use|all)\s*\(|^(?:(?:static|async|get|set|public|private|protected)\s+)*(\w+)\s*\([^;]*\)\s*(?::[^{]+)?\{"),
    "java": re.compile(r"^(?:(?:public|private|protected|static|final|abstract|synchronized|native|virtual|override|async|internal)\s+)+[\w<>\[\],.? ]+?\s+(\w+)\s*\("),
    "php": re.compile(r"^(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)\s*\("),
    "rust": re.compile(r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"),
    "c": re.compile(r"^(?!else\b|return\b|if\b|for\b|while\b|switch\b)(?:[\w:<>,&*]+[\s*&]+)+([\w:~]+)\s*\([^;]*$"),
    "shell": re.compile(r"^(?:function\s+([\w:.-]+)|([\w:.-]+)\s*\(\))"),
}
_LIKE = {"typescript": "javascript", "csharp": "java", "cpp": "c"}


@dataclass(frozen=True)
class Scope:
    name: str
    start: int
    end: int
    lines: tuple[tuple[int, str], ...]


@dataclass(frozen=True)
class _Var:
    source: Source
    line: int
    confidence: float
    steps: tuple[tuple[int, str], ...] = ()
    clean: frozenset[str] = field(default_factory=frozenset)


def _depth(line: str) -> int:
    """Braces opened less closed, outside of strings and line comments."""
    plain = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|//.*$", "", line)
    return plain.count("{") - plain.count("}")


def scopes(text: str, language: str) -> list[Scope]:
    """The functions of a file, and ``__top_level__`` with the lines outside of them; lines keep their numbers."""
    lines = text.split("\n")
    n = len(lines)
    found: list[tuple[str, int, int]] = []
    if language == "python":
        open_: list[tuple[str, int, int]] = []
        last = 0
        for i, line in enumerate(lines, 1):
            s = line.strip()
            if not s or s.startswith("#"):
                continue
            indent = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
            while open_ and indent <= open_[-1][2]:
                name, start, _ = open_.pop()
                found.append((name, start, last))
            m = re.match(r"(?:async\s+)?def\s+(\w+)\s*\(", s)
            if m:
                open_.append((m.group(1), i, indent))
            last = i
        found += [(name, start, last) for name, start, _ in open_]
    elif language == "ruby":
        stack: list[tuple[str, int, int]] = []
        depth = 0
        for i, line in enumerate(lines, 1):
            s = line.strip()
            m = re.match(r"def\s+(?:self\.)?([\w?!=]+)", s)
            if m:
                stack.append((m.group(1), i, depth))
            if re.match(r"(?:def|class|module|if|unless|while|until|for|case|begin|do)\b", s) or re.search(r"\bdo\s*(?:\|[^|]*\|)?$", s):
                depth += 1
            if re.match(r"end\b", s):
                depth -= 1
                if stack and depth <= stack[-1][2]:
                    name, start, _ = stack.pop()
                    found.append((name, start, i))
    elif _LIKE.get(language, language) in _BRACED:
        pattern = _BRACED[_LIKE.get(language, language)]
        stack = []
        pending: tuple[str, int] | None = None
        depth = 0
        for i, line in enumerate(lines, 1):
            m = pattern.match(line.strip())
            if m:
                name = next((x for x in m.groups() if x), "__anon__")
                if name not in _NO_METHOD:
                    pending = (name, i)
            d = _depth(line)
            if pending and "{" in line:
                stack.append((*pending, depth))
                pending = None
            depth += d
            while stack and depth <= stack[-1][2] and "}" in line:
                name, start, _ = stack.pop()
                found.append((name, start, i))
    covered = {i for _, a, b in found for i in range(a, b + 1)}
    out = [Scope(name, a, b, tuple((i, lines[i - 1]) for i in range(a, b + 1))) for name, a, b in sorted(found, key=lambda x: (x[1], x[2]))]
    top = tuple((i, line) for i, line in enumerate(lines, 1) if i not in covered)
    return [*out, Scope("__top_level__", 1, n, top)] if any(x.strip() for _, x in top) else out


def assignment(line: str, language: str) -> tuple[list[str], str] | None:
    """The assigned names and the right-hand side of a statement, or None."""
    s = line.strip()
    if _NO_ASSIGNMENT.match(s):
        return None
    for languages, pattern in _ASSIGNMENT:
        if not languages or language in languages:
            m = pattern.match(s)
            if m:
                return [x.strip() for x in m.group(1).split(",") if x.strip() not in ("", "_")], m.group(2).rstrip("; ")
    m = _PART_ASSIGNED.match(s)
    if m:  # a part of an object is assigned: the object carries what the part does
        return [m.group(1)], m.group(2).rstrip("; ")
    m = _DESTRUCTURED.match(s)
    if m:
        return [x for p in split_commas(m.group(1)) if (x := re.sub(r"^\.\.\.", "", re.split(r"\s*=", re.split(r":\s*", p)[-1])[0]).strip())], m.group(2).rstrip("; ")
    return None


def arguments(text: str, at: int) -> list[str]:
    """The arguments of the call whose parenthesis is the first from ``at``; without one, the rest of the text."""
    i = text.find("(", at)
    if i < 0:
        return [text[at:].strip()]
    out, depth, quote, start = [], 0, "", i + 1
    for j in range(i, len(text)):
        c = text[j]
        if quote:
            if c == quote and text[j - 1] != "\\":
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                out.append(text[start:j].strip())
                return [a for a in out if a]
        elif c == "," and depth == 1:
            out.append(text[start:j].strip())
            start = j + 1
    return [a for a in (*out, text[start:].strip()) if a]


@lru_cache(maxsize=1 << 14)
def _refers(name: str) -> re.Pattern[str]:
    return re.compile((r"(?:^|[^\w])" + re.escape(name) if name.startswith("$") else r"\b" + re.escape(name)) + r"\b")


@lru_cache(maxsize=64)
def _compiled(language: str, catalog: Catalog) -> tuple:
    own = catalog.of(language)
    return tuple((s, re.compile(s.pattern)) for s in own.sources), tuple((s, re.compile(s.pattern)) for s in own.sinks), tuple((s, re.compile(s.pattern)) for s in own.sanitizers)


_RULES = tuple((re.compile(p), factor) for p, factor in PROPAGATION)


def factor_of(expression: str, sanitized: bool) -> float:
    """What an expression keeps of its operands' taint."""
    call = _CALL.search(expression) is not None and not sanitized
    for pattern, factor in _RULES:
        if pattern.search(expression):
            return factor or (UNKNOWN_CALL if call else 0.0)
    return UNKNOWN_CALL if call else 1.0


def _full_call(lines: tuple[tuple[int, str], ...], k: int, at: int) -> str:
    """A statement with the lines up to where its parentheses, or those from the call at ``at``, are closed or the scope ends."""
    text = lines[k][1]
    parts = [text]
    depth = max(t.count("(") - t.count(")") for t in (text, text[at:]))
    for _, line in islice(lines, k + 1, None) if depth > 0 else ():
        parts.append(line.strip())
        depth += line.count("(") - line.count(")")
        if depth <= 0:
            break
    return " ".join(parts)


def split_commas(text: str) -> list[str]:
    """The parts of a text between the commas outside of brackets and strings, trimmed; empty ones are left out."""
    return arguments(f"({text})", 0)


def parameters(declaration: str, language: str) -> list[tuple[str, ...]]:
    """The names each parameter of a function's declaration brings in, by position; a destructured one brings several, and ``self`` and ``cls`` don't count."""
    at = declaration.find("(")
    if language == "go" and re.match(r"\s*func\s*\(", declaration):  # the receiver stands before the name
        at = declaration.find("(", declaration.find(")"))
    if at < 0:
        return []
    out: list[tuple[str, ...]] = []
    # commas between the angles of a type part no parameters
    plain = declaration
    while (shorter := re.sub(r"<[^<>()=;]*>", "", plain)) != plain:
        plain = shorter
    for part in arguments(plain, plain.find("(", at) if plain[at : at + 1] != "(" else at):
        part = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s+|final\s+|\.\.\.|\*{1,2}|&+)+", "", part).strip()
        if part[:1] in "{[":
            inner = part[1 : max(part.rfind("}"), part.rfind("]"))]
            names = tuple(x for p in split_commas(inner) if (x := re.sub(r"^\.\.\.", "", re.split(r"\s*=", re.split(r":\s*", p)[-1])[0]).strip()))
            out.append(names)
            continue
        head = re.split(r"\s*=(?!=)", part)[0].strip()
        if language in ("java", "csharp", "c", "cpp", "groovy"):
            m = re.search(r"([A-Za-z_]\w*)\s*(?:\[\s*\])*$", head)
        elif language == "php":
            m = re.search(r"(\$\w+)", head)
        else:
            m = re.match(r"(?:mut\s+)?([A-Za-z_$][\w$]*)", head)
        if m and m.group(1) not in ("self", "cls", "this", "void"):
            out.append((m.group(1),))
    return out


def track(
    scope: Scope, language: str, catalog: Catalog = CORE, seeds: dict[str, Source] | None = None, at_line: Callable[[int, int, dict[str, _Var]], None] | None = None
) -> list[tuple[Source, int, Sink, int, float, tuple[tuple[int, str], ...]]]:
    """The flows of a scope: source, its line, sink, its line, confidence, steps.

    ``seeds``: names that carry a source from the start. ``at_line`` is shown each line's place in the scope, its number and the variables behind it.
    """
    sources, sinks, sanitizers = _compiled(language, catalog)
    state: dict[str, _Var] = {n: _Var(x, scope.start, 1.0, ((scope.start, n),)) for n, x in (seeds or {}).items()}
    flows = []
    for k, (no, line) in enumerate(scope.lines):
        s = line.strip()
        if not s or s.startswith(("//", "#", "/*", "*")):
            continue
        made = assignment(line, language)
        cleaned = [x for x, p in sanitizers if p.search(line)]
        if made:
            names, right = made
            hit = next((x for x, p in sources if p.search(right)), None)
            carriers = sorted(((v, n) for n, v in state.items() if _refers(n).search(right)), key=lambda x: (-x[0].confidence, x[1]))
            for name in names:
                if hit is not None:
                    state[name] = _Var(hit, no, 1.0, ((no, name),))
                elif carriers:
                    v = carriers[0][0]
                    confidence = v.confidence * factor_of(right, bool(cleaned))
                    old = state.get(name)
                    if confidence > 0 and (old is None or confidence > old.confidence):
                        state[name] = replace(v, confidence=confidence, steps=(*v.steps, (no, name)))
                if name in state and cleaned:
                    state[name] = replace(state[name], clean=state[name].clean | {c for x in cleaned for c in x.neutralizes})
        if at_line is not None:
            at_line(k, no, state)
        for sink, p in sinks:
            m = p.search(line)
            if not m:
                continue
            at = m.end() - 1 if m.group().endswith("(") else m.end()
            args = arguments(_full_call(scope.lines, k, at), at)
            if sink.category == "sql_query" and (_BOUND.search(re.sub(r"\?\?|\?\s*[\w\"'(]+[^:]*:", "", line)) or (len(args) > 1 and args[0][:1] in "\"'`" and _SQL.search(args[0]))):
                continue
            some = args if -1 in sink.args or not sink.args else [args[i] for i in sink.args if i < len(args)] or args
            found: list[tuple[float, str, _Var]] = []
            for a in some:
                found += [(v.confidence, n, v) for n, v in state.items() if sink.category not in v.clean and _refers(n).search(a)]
                if not found:
                    inline = next((x for x, q in sources if q.search(a)), None)
                    if inline is not None and not any(sink.category in x.neutralizes for x in cleaned):
                        found.append((1.0, "__inline__", _Var(inline, no, 1.0)))
            if found:
                _, _, v = min(found, key=lambda x: (-x[0], x[1]))
                if not (v.source.category == "env_var" and sink.category == "log_output"):
                    flows.append((v.source, v.line, sink, no, v.confidence, v.steps))
    return flows


FLOW = "scope string, rule_id string, source_id string, source_line int, sink_id string, line_number int, sink_category string, severity int, cwe_id string, confidence_score double, steps array<struct<line:int,var:string>>"


def flows(files: DataFrame, key: str, catalog: Catalog = CORE) -> DataFrame:
    """``key`` and ``FLOW`` of every file (``key, lang, content``); languages without catalog have none."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]
    step = pa.list_(pa.struct([("line", pa.int32()), ("var", pa.string())]))
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), step]
    names = ["scope", "rule_id", "source_id", "source_line", "sink_id", "line_number", "sink_category", "severity", "cwe_id", "confidence_score", "steps"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not _compiled(lang, catalog)[0]:
                    continue
                for sc in scopes(text, lang):
                    for src, at, sink, no, confidence, steps in track(sc, lang, catalog):
                        rows.append((k, sc.name, f"TAINT-{sink.category}", src.id, at, sink.id, no, sink.category, sink.severity, sink.cwe, confidence, [{"line": i, "var": v} for i, v in steps]))
            cols = list(zip(*rows, strict=True)) or [()] * 12
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]], [key, *names])

    return spread(files.where(F.col("content").isNotNull() & F.col("lang").isNotNull()).select(key, "lang", "content")).mapInArrow(run, f"{key} {kind}, {FLOW}")


def function_scopes(files: DataFrame, key: str) -> DataFrame:
    """``key, name, start_line, end_line, content_hash`` of the functions of every file; the hash is the first 16 digits of the body's SHA-256."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, s.name, s.start, s.end, "\n".join(x for _, x in s.lines)) for k, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for s in scopes(text, lang) if s.name != "__top_level__"]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], [key, "name", "start_line", "end_line", "body"])

    found = spread(files.where(F.col("content").isNotNull() & F.col("lang").isNotNull()).select(key, "lang", "content")).mapInArrow(run, f"{key} {kind}, name string, start_line int, end_line int, body string")
    return found.withColumn("content_hash", F.substring(F.sha2(F.encode("body", "UTF-8"), 256), 1, 16)).drop("body")


def as_findings(the_flows: DataFrame) -> DataFrame:
    """Flows as findings of the taint layer."""
    label = F.when(F.col("confidence_score") >= 0.7, "high").when(F.col("confidence_score") >= 0.4, "medium").otherwise("low")
    return the_flows.withColumns({"confidence": label, "tags": F.array(F.lit("taint-analysis"), F.col("sink_category")), "title": F.concat(F.lit("Tainted data reaches "), F.col("sink_id"))})


def report(the_flows: DataFrame) -> DataFrame:
    """``the_flows`` with ``report``: where foreign data came in, the names it went through and where it ended, a line each."""
    line = lambda at, text: F.concat(F.lit("  line "), at.cast("string"), F.lit(": "), text)
    way = F.transform("steps", lambda s: line(s["line"], s["var"]))
    head = F.concat("source_id", F.lit(" -> "), "sink_id", F.lit(" ("), "sink_category", F.lit(", "), F.format_number(F.col("confidence_score"), 2), F.lit(")"))
    return the_flows.withColumn("report", F.array_join(F.concat(F.array(head, line(F.col("source_line"), F.concat(F.lit("from "), "source_id"))), way, F.array(line(F.col("line_number"), F.concat(F.lit("into "), "sink_id")))), "\n"))
