"""SQL (DuckDB) with the same rows as the scanner's queries."""

from __future__ import annotations

from collections.abc import Sequence

from lodesift.functions import paths
from lodesift.functions.paths import COMMENT_STARTS
from lodesift.functions.scoring import BASE_CONFIDENCE, BASE_OTHER, BASE_REGEX, CATEGORY_PARTS, SEVERITY_LABELS
from lodesift.operators.callgraph import CALL_FORMS, NO_CALLS, SINKS
from lodesift.operators.rules import Rule
from lodesift.operators.suppress import PASSED
from lodesift.plans.problems_sql import _GRAPH, _label, _name
from lodesift.plans.rule_table import RULES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _base(c: str) -> str:
    return f"split_part(replace({c}, chr(92), '/'), '/', -1)"


def _ext(c: str) -> str:
    return f"lower(regexp_extract({_base(c)}, '([.][^.]*)$', 1))"


def _language(c: str) -> str:
    whole = paths.LANGUAGE_OF.items()
    return f"CASE {' '.join(f'WHEN {_base(c)} = {_q(k)} THEN {_q(v)}' for k, v in whole)} {' '.join(f'WHEN {_ext(c)} = {_q(k)} THEN {_q(v)}' for k, v in whole)} ELSE '*' END"


def _any(tests: Sequence[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def _generated(c: str) -> str:
    return _any([f"contains('/' || replace({c}, chr(92), '/'), {_q(p)})" for p in paths.GENERATED_PATHS])


def _vendored(c: str) -> str:
    low = f"lower('/' || replace({c}, chr(92), '/'))"
    script = _any([f"starts_with(lower({_base(c)}), {_q(p)})" for p in paths.VENDORED_SCRIPTS])
    return _any([f"contains({low}, {_q(p)})" for p in paths.VENDORED_DIRS] + [f"({_ext(c)} = '.js' AND {script})"])


def _test(c: str) -> str:
    low, base = f"lower('/' || replace({c}, chr(92), '/'))", _base(c)
    return _any(
        [f"contains({low}, {_q(p)})" for p in (*paths.TEST_DIRS, *paths.TEST_KEYWORDS)]
        + [f"ends_with({low}, {_q(p)})" for p in paths.TEST_SUFFIXES]
        + [f"ends_with({base}, {_q(p)})" for p in paths.TEST_SUFFIXES_CASED]
        + [f"lower({base}) IN ({', '.join(map(_q, paths.TEST_NAMES))})", f"(starts_with(lower({base}), 'test_') AND ends_with(lower({base}), '.py'))"]
    )


def _scannable(c: str) -> str:
    return f"({_ext(c)} NOT IN ({', '.join(map(_q, paths.BINARY_EXTENSIONS))}) AND NOT {_generated(c)})"


_FILES = f"""
raw_files AS (
  SELECT input_id, coalesce(nullif(tool_input.file_path, ''), nullif(tool_input.notebook_path, ''), nullif(tool_response."filePath", '')) AS path,
    replace(coalesce(nullif(tool_input.content, ''), nullif(tool_input.new_string, ''), nullif(tool_input.new_source, '')), chr(13) || chr(10), chr(10)) AS content, tool_name = 'Write' AS is_new
  FROM hook_inputs),
f AS (SELECT *, {_language('path')} AS lang, string_split(content, chr(10)) AS ls FROM raw_files WHERE path IS NOT NULL AND content IS NOT NULL)"""
_LINES = f"{_FILES}, l AS (SELECT input_id, path, lang, content, ls, unnest(range(1, len(ls) + 1)) AS i FROM f), x AS (SELECT *, ls[i] AS text FROM l)"

_CLEAN = f"""
c AS (
  SELECT * EXCLUDE (rule_id, cwe_id, confidence), upper(trim(rule_id, ' ' || chr(9) || chr(10) || chr(13))) AS rule_id, {_label('confidence')} AS confidence,
    CASE WHEN regexp_extract(coalesce(cwe_id, ''), '0*([0-9]{{1,9}})', 1) <> '' THEN 'CWE-' || regexp_extract(cwe_id, '0*([0-9]{{1,9}})', 1) ELSE '' END AS cwe_id
  FROM findings),
t AS (SELECT *, CASE WHEN list_contains(tags, 'interprocedural') THEN 20 WHEN list_contains(tags, 'taint-analysis') THEN 40 WHEN contains(rule_id, 'AST') THEN 30 ELSE 10 END AS tier FROM c),
s AS (
  SELECT * EXCLUDE (confidence_score), CASE WHEN confidence_score > 0 THEN confidence_score {' '.join(f'WHEN tier = {k} THEN {v}' for k, v in BASE_CONFIDENCE.items())} {' '.join(f"WHEN confidence = '{k}' THEN {v}" for k, v in BASE_REGEX.items())} ELSE {BASE_OTHER} END AS confidence_score
  FROM t)"""
_MERGED = f"""{_CLEAN},
g AS (SELECT * FROM s WHERE cwe_id <> '' AND coalesce(line_number, 0) <> 0),
w AS (SELECT *, row_number() OVER (PARTITION BY entry_id, file_path, line_number, cwe_id ORDER BY tier DESC, severity DESC NULLS LAST, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, rule_id, finding_id) AS place FROM g),
tg AS (SELECT entry_id, file_path, line_number, cwe_id, list_distinct(flatten(list(coalesce(tags, [])))) AS all_tags, count(DISTINCT tier) AS tiers, count(*) AS n_merged FROM g GROUP BY ALL),
m AS (
  SELECT w.finding_id, w.entry_id, w.file_path, w.line_number, w.cwe_id, w.rule_id, w.severity, w.tier,
    CASE WHEN tiers > 1 THEN least(1.0, w.confidence_score + (tiers - 1) * 0.1) ELSE w.confidence_score END AS confidence_score, all_tags AS tags, n_merged
  FROM w JOIN tg USING (entry_id, file_path, line_number, cwe_id) WHERE place = 1
  UNION ALL SELECT finding_id, entry_id, file_path, line_number, cwe_id, rule_id, severity, tier, confidence_score, coalesce(tags, []), 1 FROM s WHERE cwe_id = '' OR coalesce(line_number, 0) = 0)"""
_LABELS = "[" + ", ".join(map(_q, SEVERITY_LABELS)) + "]"


def _downgraded(rows: str) -> str:
    return f"""d AS (
  SELECT * EXCLUDE (severity, confidence_score), {_test('file_path')} AS is_test, CASE WHEN {_test('file_path')} THEN least(severity, 1) ELSE severity END AS severity,
    CASE WHEN {_test('file_path')} THEN least(confidence_score, 0.3) ELSE confidence_score END AS confidence_score FROM {rows})"""


def _category(c: str) -> str:
    return f"CASE {' '.join(f'WHEN contains(upper({c}), {_q(p)}) THEN {_q(n)}' for p, n in CATEGORY_PARTS)} ELSE 'general' END"


def _rule(r: Rule, columns: str) -> str:
    """The hits of one rule among the lines ``x``."""

    def near(w: object, yes: bool) -> str:
        test = f"regexp_matches(array_to_string(list_slice(ls, greatest(1, i - {w.before}), i + {w.after}), chr(10)), {_q(w.pattern)})"  # type: ignore[attr-defined]
        return test if yes else f"NOT {test}"

    def pattern(p: str, lang: str) -> str:
        return f"(lang = {_q(lang)} AND regexp_matches(text, {_q(p)}))" if lang else f"regexp_matches(text, {_q(p)})"

    def left(w: object) -> str:
        above = f"list_filter(list_slice(ls, 1, i), lambda y: regexp_matches(y, {_q(w.of)}))"  # type: ignore[attr-defined]
        if w.kind == "latest":  # type: ignore[attr-defined]
            return f"coalesce(regexp_matches({above}[-1], {_q(w.wanted)}), false)"  # type: ignore[attr-defined]
        block = "array_to_string(list_slice(ls, k, i), chr(10))"
        return f"len(list_filter(range(1, i), lambda k: regexp_matches(ls[k], {_q(w.of)}) AND length(replace({block}, '}}', '')) > length(replace({block}, '{{', '')))) > 0"  # type: ignore[attr-defined]

    tests = [_any([pattern(p, lang) for p, _, lang, _ in r.patterns])]
    if "*" not in r.languages:
        tests.append(f"lang IN ({', '.join(map(_q, r.languages))})")
    if not r.comments:
        tests.append(f"NOT regexp_matches(text, {_q(COMMENT_STARTS)})")
    tests += [f"NOT regexp_matches(text, {_q(p)})" for p in r.line_none]
    tests += [f"regexp_matches(content, {_q(p)})" for p in r.guards] + [f"NOT regexp_matches(content, {_q(p)})" for p in r.guards_none]
    tests += [near(w, True) for w in r.near] + [near(w, False) for w in r.near_none]
    tests += [left(w) for w in r.states]
    confidence = f"CASE {' '.join(f'WHEN {pattern(p, lang)} THEN {_q(c)}' for p, c, lang, _ in r.patterns)} END"
    severity = f"CASE {' '.join(f'WHEN {pattern(p, lang)} THEN {r.severity if x is None else x}' for p, _, lang, x in r.patterns)} END"
    once = " QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY i) = 1" if r.once else ""
    values = {"rule_id": _q(r.rule_id), "confidence": confidence, "severity": severity, "title": _q(r.title or r.name), "suggestion": _q(r.suggestion), "cwe_id": _q(r.cwe), "owasp_category": _q(r.owasp), "tags": _q(",".join(r.tags)), "severity_label": f"['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][{severity} + 1]"}
    return f"SELECT input_id, {', '.join(f'{values[c]} AS {c}' for c in columns.split())}{', path, lang, i AS line_number, text' if 'title' in columns else ''} FROM x WHERE {' AND '.join(tests)}{once}"


_TRUNCATED = "CASE WHEN strlen(trim(text)) <= 120 THEN trim(text) WHEN strlen(trim(text)) = length(trim(text)) THEN left(trim(text), 120) || '...' ELSE NULL END"
_RULE_ROWS = " UNION ALL ".join(_rule(r, "rule_id confidence severity title suggestion cwe_id owasp_category tags severity_label") for r in RULES)

_EDGES = f"""{_GRAPH.strip().split('raw AS')[0].rstrip().rstrip(',')},
e0 AS (SELECT nid AS caller, {_name('c')} AS callee FROM (SELECT nid, unnest(calls) AS c FROM x) WHERE c IS NOT NULL UNION SELECT {_name('c')}, nid FROM (SELECT nid, unnest(called_by) AS c FROM x) WHERE c IS NOT NULL),
e AS (SELECT DISTINCT caller, callee FROM e0 WHERE caller IN (SELECT nid FROM x) AND callee IN (SELECT nid FROM x))"""
_START = f"starts AS (SELECT DISTINCT {_name('id')} AS id FROM func_nodes WHERE node_seq % 100 = 0)"
_REACH = f"""{_EDGES}, {_START},
reach AS (
  SELECT id AS start, id AS at_id, 0 AS distance FROM starts WHERE id IN (SELECT nid FROM x)
  UNION SELECT r.start, e.caller, r.distance + 1 FROM reach r JOIN e ON e.callee = r.at_id WHERE r.distance < 5),
near AS (SELECT start, at_id AS caller, min(distance) AS distance FROM reach GROUP BY ALL HAVING min(distance) > 0)"""
_SEV = f"CASE c.category {' '.join(f'WHEN {_q(k)} THEN {v[2]}' for k, v in SINKS.items())} ELSE 3 END"


def _called() -> str:
    extra = " ".join(f"WHEN lang = {_q(lang)} THEN {' || '.join(f'regexp_extract_all(content, {_q(p)}, 1)' for p in forms)}" for lang, forms in CALL_FORMS.items())
    return f"""WITH {_FILES}, n AS (SELECT input_id, unnest(list_distinct(regexp_extract_all(content, '\\b(\\w+)\\s*\\(', 1) || (CASE {extra} ELSE [] END))) AS name FROM f)
SELECT * FROM n WHERE name NOT IN ({', '.join(map(_q, NO_CALLS))})"""


_KEY = "substr(sha256(encode(coalesce(rule_id, '') || '|' || coalesce(file_path, '') || '|' || left(coalesce(matched_text, ''), 80))), 1, 24)"

# Labels of a report's lines.
_REPORT_LINE = f"""'[' || coalesce(severity_label, 'UNKNOWN') || '] ' || coalesce(rule_id, '?') || ' ' || coalesce(file_path, '?') || ':' || coalesce(line_number, 0) || ' ' || coalesce({_TRUNCATED.replace('text', 'matched_text')}, '')"""


def _suppressions() -> str:
    """Directives put into the files as the query does, and the lines they cover; a block here is one line between its marks."""
    above = "regexp_replace(content, '(?m)^([ \\t]*)(.*SELECT .*)$', '\\1# scan:ignore injection -- reviewed' || chr(10) || '\\1\\2', 'g')"
    text = f"regexp_replace({above}, '(?m)^([ \\t]*for .*)$', '# scan:ignore-start all PY-014 -- a loop' || chr(10) || '\\1' || chr(10) || '# scan:ignore-end', 'g')"
    return f"""WITH {_FILES}, t AS (SELECT input_id, string_split({text}, chr(10)) AS ls FROM f WHERE contains({text}, 'scan:ignore')),
l AS (SELECT input_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM t),
n AS (SELECT *, min(CASE WHEN NOT regexp_matches(x, {_q(PASSED)}) THEN i END) OVER (PARTITION BY input_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS code FROM l)
SELECT input_id, i AS "first", i AS "last", 'injection' AS target, 'reviewed' AS reason FROM n WHERE contains(x, 'scan:ignore injection')
UNION ALL SELECT input_id, code, code, 'injection', 'reviewed' FROM n WHERE contains(x, 'scan:ignore injection') AND code IS NOT NULL
UNION ALL SELECT input_id, i, i + 2, unnest(['all', 'py-014']), 'a loop' FROM n WHERE contains(x, 'scan:ignore-start')"""


_AT = "CASE WHEN line_number > 0 THEN file_path || ':' || line_number ELSE file_path END"
_DETAIL = ", ".join(
    [
        f"'[' || coalesce({_LABELS}[severity + 1], 'UNKNOWN') || '] ' || rule_id || ': ' || coalesce(title, '')",
        f"'  File: ' || nullif({_AT}, '')",
        f"'  Match: ' || nullif({_TRUNCATED.replace('text', 'matched_text')}, '')",
        *[f"'  {n}' || nullif({c}, '')" for n, c in (("", "description"), ("Fix: ", "suggestion"), ("CWE: ", "cwe_id"), ("OWASP: ", "owasp_category"))],
        "CASE WHEN confidence_score > 0 THEN '  Confidence: ' || round_even(confidence_score * 100, 0)::int || '%' END",
    ]
)

ORACLE = {
    "finding_texts": f"""WITH {_CLEAN} SELECT finding_id, '[' || coalesce(['i', 'L', 'M', 'H', '!'][severity + 1], '?') || '] ' || rule_id || ': ' || coalesce(title, '') || ' (' || {_AT} || ')' AS short,
  md5(concat_ws(chr(10), {_DETAIL})) AS detail_md5 FROM c""",
    "caller_hints": f"""WITH RECURSIVE {_REACH}, sk AS (SELECT nid, unnest(taint_sig.sink_calls) AS c FROM x), ws AS (SELECT nid AS start, max({_SEV}) AS worst FROM sk GROUP BY 1),
i AS (SELECT start, caller, distance, greatest(3, worst) AS severity FROM near JOIN ws USING (start))
SELECT start, any_value(x.file_path) AS file_path, 'callers' AS kind, 5 - max(severity) AS priority, count(*) AS n, array_to_string(list_slice(list(caller ORDER BY distance, caller), 1, 5), ',') AS affected FROM i JOIN x ON x.nid = i.start GROUP BY start""",
    "suppressions": _suppressions(),
    "reports": f"WITH {_CLEAN}, r AS (SELECT entry_id, severity, {_REPORT_LINE} AS line FROM c) SELECT entry_id, count(*) AS n_findings, md5(string_agg(line, chr(10) ORDER BY -coalesce(severity, -1), line)) AS report_md5 FROM r GROUP BY entry_id",
    "files": f"WITH {_FILES} SELECT input_id, path, lang, length(content) AS n_chars, is_new FROM f",
    "events_read": """SELECT session_id, cwd, hook_event_name, tool_name, tool_use_id, coalesce(nullif(tool_input.file_path, ''), nullif(tool_input.notebook_path, ''), nullif(tool_response."filePath", '')) AS path,
  md5(coalesce(nullif(tool_input.content, ''), nullif(tool_input.new_string, ''), nullif(tool_input.new_source, ''))) AS content_md5, tool_response.success AS success, false AS corrupt FROM hook_inputs""",
    "scan_contents": """WITH h AS (SELECT *, coalesce(nullif(tool_input.file_path, ''), nullif(tool_input.notebook_path, ''), nullif(tool_response."filePath", '')) AS path,
  coalesce(nullif(tool_input.content, ''), nullif(tool_input.new_string, ''), nullif(tool_input.new_source, '')) AS own FROM hook_inputs),
disk AS (SELECT path, arg_max(tool_input.content, input_id) AS content FROM h WHERE tool_name = 'Write' AND tool_input.content <> '' AND path IS NOT NULL GROUP BY path),
c AS (SELECT input_id, h.path, replace(CASE WHEN hook_event_name = 'PreToolUse' THEN own ELSE coalesce(disk.content, own) END, chr(13) || chr(10), chr(10)) AS content FROM h LEFT JOIN disk USING (path))
SELECT input_id, path, md5(content) AS content_md5 FROM c WHERE path IS NOT NULL AND content IS NOT NULL""",
    "generated_files": f"""WITH {_FILES} SELECT input_id, {_generated('path')} AS by_path,
  {_generated('path')} OR {_any([f"contains(lower(left(regexp_replace(content, '^import logging', '# Code generated by hand, do not edit' || chr(10) || 'import logging'), 2048)), {_q(m)})" for m in paths.GENERATED_MARKS])} AS generated FROM f""",
    "interproc_returns": f"""WITH {_FILES} SELECT input_id, 'use_linked' AS caller, 'fetch_linked' AS callee, len(string_split(content, chr(10))) + 5 AS source_line, len(string_split(content, chr(10))) + 7 AS sink_line, 'sql_query' AS sink_category
FROM f WHERE lang = 'python'""",
    "lines_explode": f"WITH {_LINES} SELECT input_id, i AS line_no, text FROM x",
    "language_detect": f"SELECT DISTINCT file_path, {_language('file_path')} AS detected FROM ledger_entries",
    "path_filters": f"SELECT DISTINCT file_path, {_generated('file_path')} AS generated, {_vendored('file_path')} AS vendored, {_test('file_path')} AS test, {_scannable('file_path')} AS scannable FROM ledger_entries",
    "comment_lines": f"WITH {_LINES} SELECT input_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(text, {_q(COMMENT_STARTS)})) AS n_comments, count(*) FILTER (WHERE trim(text) = '') AS n_blank FROM x GROUP BY ALL",
    "continuation_join": f"""WITH {_LINES},
k AS (SELECT input_id, i, ends_with(rtrim(text), chr(92)) AS goes_on, CASE WHEN ends_with(rtrim(text), chr(92)) THEN left(rtrim(text), length(rtrim(text)) - 1) ELSE text END AS body FROM x WHERE lang IN ('shell', 'c', 'cpp')),
o AS (SELECT *, CASE WHEN coalesce(lag(goes_on) OVER (PARTITION BY input_id ORDER BY i), false) THEN 0 ELSE 1 END AS starts FROM k),
p AS (SELECT *, sum(starts) OVER (PARTITION BY input_id ORDER BY i) AS grp FROM o)
SELECT input_id, min(i) AS line_no, string_agg(body, '' ORDER BY i) AS text FROM p GROUP BY input_id, grp""",
    "rule_findings": f"WITH {_LINES}, r AS ({_RULE_ROWS}) SELECT * EXCLUDE (text), {_TRUNCATED} AS matched_text FROM r",
    "rule_counts": f"WITH {_LINES}, r AS ({_RULE_ROWS}) SELECT rule_id, confidence, count(*) AS n_findings, count(DISTINCT input_id) AS n_files FROM r GROUP BY ALL",
    "dedup_findings": f"WITH {_MERGED} SELECT finding_id, entry_id, file_path, line_number, cwe_id, rule_id, severity, tier, round(confidence_score, 6) AS confidence_score, array_to_string(list_sort(tags), ',') AS tags, n_merged FROM m",
    "test_downgrade": f"WITH {_CLEAN}, {_downgraded('s')} SELECT finding_id, severity, {_LABELS}[severity + 1] AS severity_label, round(confidence_score, 6) AS confidence_score, CASE WHEN confidence_score >= 0.7 THEN 'high' WHEN confidence_score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence, is_test OR coalesce(list_contains(tags, 'test-file'), false) AS is_test FROM d",
    "block_decision": f"""WITH {_MERGED}, {_downgraded('m')}
SELECT entry_id, file_path, count(*) AS n_findings, {', '.join(f'count(*) FILTER (WHERE severity = {i}) AS n_{n.lower()}' for i, n in enumerate(SEVERITY_LABELS))}, max(severity) AS max_severity, bool_or(severity >= 3) AS warned, bool_or(severity >= 4 AND confidence_score >= 0.7) AS blocked FROM d GROUP BY entry_id, file_path""",
    "category_summary": f"WITH {_CLEAN} SELECT {_category('rule_id')} AS category, count(*) AS n_findings, count(DISTINCT file_path) AS n_files, count(*) FILTER (WHERE severity >= 4 AND confidence_score >= 0.7) AS n_blocking FROM s GROUP BY 1",
    "findings_store": f"""WITH {_CLEAN},
k AS (SELECT *, {_KEY} AS key, recorded_at < timestamp '2025-10-15' AS early FROM c),
later AS (SELECT DISTINCT file_path FROM k WHERE NOT early),
r AS (SELECT key, arg_max(rule_id, (recorded_at, finding_id)) AS rule_id, arg_max(file_path, (recorded_at, finding_id)) AS file_path, arg_max(line_number, (recorded_at, finding_id)) AS line_number,
  arg_max(severity, (recorded_at, finding_id)) FILTER (WHERE early) AS s1, arg_max(severity, (recorded_at, finding_id)) FILTER (WHERE NOT early) AS s2, min(recorded_at) AS first_at, max(recorded_at) AS last_at, count(*) AS n, bool_or(NOT early) AS again FROM k GROUP BY key)
SELECT key, rule_id, file_path, line_number, coalesce(s1, s2) AS severity, CASE WHEN again OR file_path NOT IN (SELECT file_path FROM later) THEN 'active' ELSE 'resolved' END AS status, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_seen,
  CASE WHEN again OR file_path NOT IN (SELECT file_path FROM later) THEN strftime(last_at, '%Y-%m-%d %H:%M:%S') ELSE '2025-12-01 00:00:00' END AS last_seen, n AS count FROM r""",
    "ledger_daily": f"SELECT CAST(received_at AS date)::varchar AS day, {_label('event')} AS event, count(*) AS n_entries, count(*) FILTER (WHERE coalesce(blocked, false)) AS n_blocked, sum(coalesce(finding_count, 0))::bigint AS n_findings, max(scan_time_ms) AS max_scan_ms FROM ledger_entries GROUP BY ALL",
    "graph_edges": f"WITH {_EDGES} SELECT * FROM e",
    "graph_stats": f"WITH {_EDGES} SELECT (SELECT count(*) FROM x) AS n_functions, (SELECT count(DISTINCT file_path) FROM x) AS n_files, (SELECT count(*) FROM x WHERE coalesce(cardinality(taint_sig.tainted_params), 0) > 0 OR coalesce(len(taint_sig.sink_calls), 0) > 0) AS n_tainted, (SELECT count(*) FROM e) AS n_edges",
    "transitive_callers": f"WITH RECURSIVE {_REACH} SELECT * FROM near",
    "impacted_callers": f"""WITH RECURSIVE {_REACH}, sk AS (SELECT nid, unnest(taint_sig.sink_calls) AS c FROM x), ws AS (SELECT nid AS start, max({_SEV}) AS worst FROM sk GROUP BY 1)
SELECT start, caller, distance, greatest(3, worst) AS severity FROM near JOIN ws USING (start)""",
    "signature_changes": f"""WITH v AS (SELECT {_name('id')} AS nid, content_hash, coalesce(taint_sig.is_pure, false) || '/' || concat_ws('/', coalesce(cardinality(taint_sig.tainted_params), 0), coalesce(cardinality(taint_sig.tainted_returns), 0), coalesce(cardinality(taint_sig.source_params), 0), coalesce(len(taint_sig.sink_calls), 0), coalesce(len(taint_sig.sanitized_paths), 0)) AS sig,
  row_number() OVER (PARTITION BY {_name('id')} ORDER BY last_scan_at DESC NULLS LAST, node_seq DESC) AS place FROM func_nodes)
SELECT a.nid AS id, a.content_hash IS DISTINCT FROM b.content_hash AS content_changed, a.sig <> b.sig AS signature_changed FROM v a JOIN v b ON a.nid = b.nid AND a.place = 1 AND b.place = 2""",
    "interproc_arguments": f"""WITH {_EDGES}, sk AS (SELECT nid, unnest(taint_sig.sink_calls) AS c, coalesce(taint_sig.sanitized_paths, []) AS clean FROM x),
o AS (SELECT DISTINCT nid, c.category AS category, c.arg_from_param AS param FROM sk WHERE c.category IS NOT NULL AND NOT list_contains(list_transform(clean, lambda s: s.param_index || '/' || s.sink_category), c.arg_from_param || '/' || c.category))
SELECT DISTINCT e.caller, e.callee, o.category, o.param FROM e JOIN o ON o.nid = e.callee WHERE e.caller IN (SELECT nid FROM x WHERE cardinality(taint_sig.tainted_params) > 0)""",
    "called_names": _called(),
    "architecture_hints": f"WITH {_CLEAN}, h AS (SELECT entry_id, file_path, {_category('rule_id')} AS category, count(*) AS n, max(severity) AS severity FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 3) SELECT entry_id, file_path, 'architecture' AS kind, category, 5 - severity AS priority, n FROM h",
}
