"""Line rules: a declarative table of patterns, applied to whole files without a shuffle.

A rule has patterns for lines and conditions around them: patterns the file must (not) have, a window of lines that must (not)
have one, patterns that cancel a hit, a path, once per file. All become one array expression per file over its array of
lines; only the hits are exploded. Languages come first, then texts that every match has (``literals``) and a pattern over the whole content, so that
most rules cost a file a few searches for a text.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.paths import COMMENT_STARTS
from lodesift.functions.scoring import severity_label
from lodesift.functions.text import truncated
from lodesift.operators.comments import begins_in
from lodesift.session import spread

#: Rules per array column; one expression over all of a large table would be too deep. The files are read once.
BATCH = 24


@dataclass(frozen=True)
class Window:
    """Lines from ``before`` above a hit to ``after`` below it, joined by line ends, and the pattern looked for in them."""

    pattern: str
    before: int
    after: int


@dataclass(frozen=True)
class State:
    """What the lines above a hit must have left behind.

    ``latest``: of the lines up to the hit that match ``of``, the last one matches ``wanted``; ``inside``: the hit lies in a braced block
    that a line matching ``of`` opened.
    """

    kind: str
    of: str
    wanted: str = ""


@dataclass(frozen=True)
class Rule:
    """One rule; of ``patterns`` (pattern, confidence, language or none, severity or None for the rule's) the first that matches a line gives its text, confidence and severity."""

    rule_id: str
    name: str
    severity: int
    languages: tuple[str, ...]
    patterns: tuple[tuple[str, str, str, int | None], ...]
    cwe: str = ""
    owasp: str = ""
    title: str = ""
    suggestion: str = ""
    tags: tuple[str, ...] = ()
    category: str = ""
    guards: tuple[str, ...] = ()
    guards_none: tuple[str, ...] = ()
    near: tuple[Window, ...] = ()
    near_none: tuple[Window, ...] = ()
    line_none: tuple[str, ...] = ()
    path: str = ""
    once: bool = False
    comments: bool = field(default=False)
    states: tuple[State, ...] = ()

    def __post_init__(self) -> None:
        for p in (*[p for p, *_ in self.patterns], *[x for w in self.states for x in (w.of, w.wanted)], *self.guards, *self.guards_none, *[w.pattern for w in (*self.near, *self.near_none)], *self.line_none, self.path):
            check_pattern(p)


def check_pattern(pattern: str) -> None:
    """Rejects patterns outside of the dialect shared by linear-time engines: no look-around, back references or possessive repeats."""
    if re.search(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|[*+?}]\+", re.sub(r"\\\\", "", pattern)):
        raise ValueError(f"not in the dialect: {pattern}")
    re.compile(pattern)


def literals(pattern: str) -> tuple[str, ...]:
    """Texts in lower case of which one at least is in every text that the pattern matches, whatever its case; none if there are no such texts of three characters."""

    def of(seq: object) -> tuple[str, ...]:
        best: tuple[str, ...] = ()
        run = ""

        def better(some: tuple[str, ...]) -> None:
            nonlocal best
            if some and min(map(len, some)) > (min(map(len, best)) if best else 2):
                best = some

        for op, arg in seq:  # type: ignore[attr-defined]
            name = str(op)
            if name == "LITERAL" and len(chr(arg).lower()) == 1:
                run += chr(arg).lower()
                continue
            better((run,) if run else ())
            run = ""
            if name == "SUBPATTERN":
                better(of(arg[-1]))
            elif name == "BRANCH":
                each = [of(x) for x in arg[1]]
                better(tuple(t for x in each for t in x) if all(each) else ())
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                better(of(arg[2]))
        better((run,) if run else ())
        return best

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        import re._parser as parser

    return tuple(dict.fromkeys(of(parser.parse(pattern))))


def load(path: str | Path) -> list[Rule]:
    """Rules from a JSON file of the rule format: a list of objects, or an object with ``defaults`` and ``rules``.

    An entry has ``id``, ``name``, ``patterns`` (texts or ``{"regex", "confidence", "language"}``), ``severity`` (a name or 0-4),
    ``languages``, and any other field of ``Rule``; a pattern with a ``language`` counts in files of that only; ``safe_patterns`` cancel a hit on the line.
    """
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    defaults, entries = (spec.get("defaults", {}), spec["rules"]) if isinstance(spec, dict) else ({}, spec)
    return [parse({**defaults, **e}) for e in entries]


def parse(e: dict) -> Rule:
    names = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
    severity = e.get("severity", 2)
    usual = e.get("confidence", "medium")

    def level(of: object) -> int:
        return names[of.lower()] if isinstance(of, str) else int(of)  # type: ignore[call-overload]

    patterns = tuple((p, usual, "", None) if isinstance(p, str) else (p["regex"], p.get("confidence", usual), p.get("language", ""), level(p["severity"]) if "severity" in p else None) for p in e["patterns"])
    return Rule(
        e["id"],
        e.get("name", e["id"]),
        level(severity),
        tuple(e.get("languages", ["*"])),
        patterns,
        e.get("cwe", ""),
        e.get("owasp", ""),
        e.get("title", e.get("name", "")),
        e.get("suggestion", ""),
        tuple(e.get("tags", ())),
        e.get("category", ""),
        tuple(e.get("guards", ())),
        tuple(e.get("guards_none", ())),
        tuple(Window(**w) for w in e.get("near", ())),
        tuple(Window(**w) for w in e.get("near_none", ())),
        tuple(e.get("line_none", e.get("safe_patterns", ()))),
        e.get("path", ""),
        bool(e.get("once", False)),
        bool(e.get("comments", False)),
        tuple(State(**w) for w in e.get("states", ())),
    )


def coverage(rules: Sequence[Rule]) -> list[tuple[str, int, int, list[int]]]:
    """Per id prefix: rules, repeated ids, and the gaps in their numbers."""
    by: dict[str, list[int]] = {}
    for r in rules:
        prefix, _, number = r.rule_id.rpartition("-")
        if number.isdigit():
            by.setdefault(prefix, []).append(int(number))
    return [(p, len(n), len(n) - len(set(n)), sorted(set(range(1, max(n) + 1)) - set(n))) for p, n in sorted(by.items())]


def _quoted(text: str) -> str:
    """A text as a literal of the expression language."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _hits(rule: Rule, number: int) -> str:
    """The array of a rule's hits, as an expression over the columns ``lang, path, content, __ls, __low``.

    A hit is ``rule`` (its number), ``line_no``, ``ord`` (of the pattern) and ``text``. A table of rules is made of texts, since each column object would be a call into the JVM.
    """

    def like(text: str, pattern: str) -> str:
        return f"{text} RLIKE {_quoted(pattern)}"

    def tested(pattern: str, lang: str) -> str:
        return f"(lang = {_quoted(lang)} AND {like('t', pattern)})" if lang else f"({like('t', pattern)})"

    def window(w: Window) -> str:
        first = f"greatest(1, i + 1 - {w.before})"
        return f"(array_join(slice(__ls, {first}, i + {2 + w.after} - {first}), '\\n') RLIKE {_quoted(w.pattern)})"

    def left_behind(w: State) -> str:
        above = "slice(__ls, 1, i + 1)"
        if w.kind == "latest":
            of = f"filter({above}, y -> {like('y', w.of)})"
            return f"coalesce({like(f'try_element_at({of}, -1)', w.wanted)}, false)" if w.wanted else f"size({of}) > 0"
        block = "array_join(slice(__ls, k + 1, i - k + 1), '\\n')"
        opened = f"filter(transform({above}, (y, k) -> CASE WHEN {like('y', w.of)} THEN k END), k -> k IS NOT NULL)"
        return f"exists({opened}, k -> k < i AND char_length(replace({block}, '}}')) > char_length(replace({block}, '{{')))"

    tests = ["(" + " OR ".join(tested(p, lang) for p, _, lang, _ in rule.patterns) + ")"]
    if not rule.comments:
        tests.append(f"NOT ({like('t', COMMENT_STARTS)})")
    tests += [f"NOT ({like('t', p)})" for p in rule.line_none]
    tests += [window(w) for w in rule.near] + [f"NOT {window(w)}" for w in rule.near_none] + [left_behind(w) for w in rule.states]
    which = "".join(f" WHEN {tested(p, lang)} THEN {k}" for k, (p, _, lang, _) in enumerate(rule.patterns[:-1]))
    order = f"CASE{which} ELSE {len(rule.patterns) - 1} END" if which else "0"
    hit = f"named_struct('rule', {number}, 'line_no', i + 1, 'ord', {order}, 'text', t)"
    found = f"filter(transform(__ls, (t, i) -> CASE WHEN {' AND '.join(tests)} THEN {hit} END), h -> h IS NOT NULL)"
    if rule.once:
        found = f"slice({found}, 1, 1)"
    wanted = []
    if "*" not in rule.languages:
        wanted.append(f"lang IN ({', '.join(map(_quoted, rule.languages))})")
    # before any pattern is tried, the content must have a text that its matches have
    some = [literals(p) for p, *_ in rule.patterns]
    if all(some):
        wanted.append("(" + " OR ".join(f"contains(__low, {_quoted(t)})" for t in dict.fromkeys(t for x in some for t in x)) + ")")
    # a line that matches makes the content match too, so files without a match never get to their lines
    wanted.append(like("content", "(?m)" + "|".join(f"(?:{p})" for p, *_ in rule.patterns)))
    if rule.path:
        wanted.append(like("path", rule.path))
    wanted += [like("content", p) for p in rule.guards] + [f"NOT ({like('content', p)})" for p in rule.guards_none]
    return f"CASE WHEN {' AND '.join(wanted)} THEN {found} ELSE CAST(array() AS array<struct<rule:int,line_no:int,ord:int,text:string>>) END"


def apply(files: DataFrame, rules: Sequence[Rule], key: str, comment_spans: str | None = None) -> DataFrame:
    """The findings of ``files`` (``key, path, lang, content``): a row per rule and matching line.

    ``key, path, lang, rule_id, severity, severity_label, title, line_number, matched_text, suggestion, cwe_id,
    owasp_category, confidence, tags``. Files without content have none; comment lines are skipped unless the rule wants
    them; extra columns are ignored. With ``comment_spans``, the name of a column of ``comments.with_spans``, hits that begin in a comment are left out.
    """
    if not rules:
        raise ValueError("no rules")
    base = spread(files.select(key, "path", "lang", "content", *([comment_spans] if comment_spans else [])).where(F.col("content").isNotNull())).withColumns({"__ls": F.split("content", "\n", -1), "__low": F.lower("content")})
    columns = {f"__h{at}": F.expr(f"flatten(array({', '.join(_hits(r, at + k) for k, r in enumerate(rules[at : at + BATCH]))}))") for at in range(0, len(rules), BATCH)}
    kept = [key, "path", "lang", *(["content", comment_spans] if comment_spans else [])]
    rows = base.withColumns(columns).select(*kept, F.explode(F.concat(*columns)).alias("x")).select(*kept, "x.*").withColumn("matched_text", truncated(F.col("text"), 120))
    if comment_spans:
        rows = rows.where(~begins_in("content", comment_spans, "line_no", "matched_text"))

    def listed(of: Iterable[str]) -> str:
        return f"array({', '.join(of)})"

    def value(of: Iterable[str]) -> Column:
        return F.expr(f"get({listed(of)}, rule)")

    confidence = F.expr(f"get(get({listed(listed(_quoted(c) for _, c, *_ in r.patterns) for r in rules)}, rule), ord)")
    severity = F.expr(f"get(get({listed(listed(str(r.severity if x is None else x) for *_, x in r.patterns) for r in rules)}, rule), ord)")
    tags = value(f"CAST({listed(map(_quoted, r.tags))} AS array<string>)" for r in rules)
    return rows.select(
        key,
        "path",
        "lang",
        value(_quoted(r.rule_id) for r in rules).alias("rule_id"),
        severity.alias("severity"),
        value(_quoted(r.title or r.name) for r in rules).alias("title"),
        F.col("line_no").alias("line_number"),
        "matched_text",
        value(_quoted(r.suggestion) for r in rules).alias("suggestion"),
        value(_quoted(r.cwe) for r in rules).alias("cwe_id"),
        value(_quoted(r.owasp) for r in rules).alias("owasp_category"),
        confidence.alias("confidence"),
        tags.alias("tags"),
    ).withColumn("severity_label", severity_label(F.col("severity")))
