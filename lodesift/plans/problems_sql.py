"""ANSI SQL (DuckDB) with the same rows as the core's pN_ queries."""

from __future__ import annotations

from lodesift.operators.entity_features import column_name

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160) || chr(65279)"


def _label(c: str) -> str:
    return f"lower(trim({c}, {_BLANKS}))"


_FINDINGS = f"""
f AS (
  SELECT *, nullif(line_number, 0) AS line_no, try_cast(nullif(regexp_extract(cwe_id, '0*([0-9]+)', 1), '') AS bigint) AS cwe_number,
    upper(trim(rule_id, {_BLANKS})) AS rule_name,
    CASE WHEN list_contains(tags, 'interprocedural') THEN 20 WHEN list_contains(tags, 'taint-analysis') THEN 40 WHEN contains(upper(coalesce(rule_id, '')), 'AST') THEN 30 ELSE 10 END AS tier,
    CASE {_label('confidence')} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS sure
  FROM findings),
r AS (
  SELECT *, row_number() OVER g AS place, count(*) OVER k AS n_members, min(finding_id) OVER k AS first_id
  FROM f WHERE line_no IS NOT NULL AND cwe_number IS NOT NULL AND entry_id IS NOT NULL AND file_path IS NOT NULL
  WINDOW g AS (PARTITION BY entry_id, file_path, line_no, cwe_number ORDER BY tier DESC, severity DESC NULLS LAST, sure DESC, rule_name, recorded_at DESC NULLS LAST, finding_id),
    k AS (PARTITION BY entry_id, file_path, line_no, cwe_number))
"""

def _survivors() -> str:
    """Survivors by comparing all pairs of a group: who is dominated, and for each field the first that fills it."""
    fields = {
        "rule_id": f"nullif(upper(trim(rule_id, {_BLANKS})), '')",
        **{c: f"nullif(trim({c}, {_BLANKS}), '')" for c in ("severity_label", "title", "description")},
        "col_no": "col_no",
        "matched_text": "nullif(matched_text, '')",
        **{c: f"nullif(trim({c}, {_BLANKS}), '')" for c in ("suggestion", "owasp_category")},
        "lang": f"nullif({_label('lang')}, '')",
        "confidence": f"nullif({_label('confidence')}, '')",
        "confidence_score": "CASE WHEN isnan(confidence_score) THEN NULL ELSE confidence_score END",
    }
    values = ", ".join(f"{v} AS f_{c}" for c, v in fields.items())
    mask = " + ".join(f"(f_{c} IS NOT NULL)::int * {1 << i}" for i, c in enumerate(fields))
    filled = ", ".join(f"arg_min(f_{c}, place) FILTER (WHERE f_{c} IS NOT NULL) AS {c}, arg_min(finding_id, place) FILTER (WHERE f_{c} IS NOT NULL) AS d_{c}" for c in fields)
    donors = " || ".join(f"CASE WHEN d_{c} <> best_id THEN '\"{c}\":' || d_{c} || ',' ELSE '' END" for c in fields)
    return f"""WITH {_FINDINGS}, c AS (SELECT *, coalesce(epoch_us(recorded_at), -4611686018427387904) AS at_us, {values} FROM r WHERE n_members > 1),
m AS (SELECT *, {mask} AS mask FROM c),
d AS (SELECT a.finding_id FROM m a WHERE EXISTS (SELECT 1 FROM m b WHERE b.first_id = a.first_id AND b.place < a.place AND b.at_us >= a.at_us AND (b.mask & a.mask) = a.mask)),
g AS (SELECT entry_id, file_path, line_no AS line_number, cwe_number, first_id, arg_min(finding_id, place) AS best_id, count(*) AS n_members, count(*) FILTER (WHERE finding_id NOT IN (SELECT finding_id FROM d))::int AS n_skyline, {filled} FROM m GROUP BY ALL)
SELECT entry_id, file_path, line_number, cwe_number, first_id, best_id, n_members, n_skyline, {', '.join(fields)}, '{{' || rtrim({donors}, ',') || '}}' AS filled_from FROM g"""


_LEDGER = f"""
t AS (
  SELECT {_label('session_id')} AS session_id, {_label('event')} AS event, file_path, entry_id,
    concat(coalesce({_label('event')}, ''), '/', coalesce({_label('lang')}, '*'), '/', coalesce({_label('max_severity')}, '')) AS event_type,
    coalesce(blocked, false) AS blocked, coalesce(finding_count, 0) AS finding_count, trim(logged_at) AS s
  FROM ledger_entries),
e AS (
  SELECT *, CASE WHEN regexp_full_match(s, '[0-9]+') THEN try_cast(s AS bigint)
    WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?') AND s NOT LIKE '0000%'
    THEN epoch(try_cast(replace(substr(s, 1, 19), 'T', ' ') AS timestamp))::bigint
      - CASE WHEN regexp_matches(s, '[+-][0-9]{{2}}:[0-9]{{2}}$') THEN (CASE WHEN s[-6] = '-' THEN -1 ELSE 1 END) * (s[-5:-4]::int * 3600 + s[-2:]::int * 60) ELSE 0 END END AS at_s
  FROM t),
o AS (SELECT * FROM e WHERE session_id <> '' AND at_s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, at_s, event, file_path ORDER BY entry_id) = 1),
long AS (
  SELECT session_id, event_type, count(*) AS n_entries, sum(blocked::int)::bigint AS n_blocked, sum(finding_count)::bigint AS n_findings, max(at_s) AS last_epoch
  FROM o GROUP BY ALL)
"""


def _features() -> str:
    from lodesift.plans.problems import EVENT_TYPES

    listed = ", ".join(f"'{x}'" for x in EVENT_TYPES)

    def columns(kind: str, cond: str) -> str:
        n = column_name(kind)
        return ", ".join(
            [*(f'coalesce(sum({m}) FILTER (WHERE {cond}), 0)::bigint AS "{n}__{m}"' for m in ("n_entries", "n_blocked", "n_findings")), f'max(last_epoch) FILTER (WHERE {cond}) AS "{n}__last_epoch"']
        )

    return f"WITH {_LEDGER} SELECT session_id, {', '.join(columns(x, f'event_type = {chr(39)}{x}{chr(39)}') for x in EVENT_TYPES)}, {columns('other', f'event_type NOT IN ({listed})')} FROM long GROUP BY session_id"


def _name(c: str) -> str:
    """A function's id, resolved: DuckDB has no fold over path parts with a stack, so each ``x/..`` is removed by a pattern, several times."""
    t = f"replace(trim({c}, {_BLANKS}), chr(92), '/')"
    name = f"regexp_extract({t}, '(:[^:]*)$', 1)"
    path = f"left({t}, (length({t}) - length({name}))::int)"
    out = f"regexp_replace(regexp_replace({path}, '/([.]/)+', '/', 'g'), '^([.]/)+', '')"
    for _ in range(4):
        out = f"regexp_replace({out}, '/[^/.][^/]*/[.][.](/|$)', '/')"
    return f"concat({out}, {name})"


_GRAPH = f"""
v AS (
  SELECT *, {_name('id')} AS nid FROM func_nodes),
s AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY nid ORDER BY last_scan_at DESC NULLS LAST, node_seq DESC) = 1),
x AS (SELECT * FROM s WHERE coalesce(lower(trim(op)), '') <> 'remove'),
raw AS (
  SELECT 'calls' AS ref_field, nid AS owner_id, unnest(calls) AS c, last_scan_at AS at_s FROM x
  UNION ALL SELECT 'called_by', nid, unnest(called_by), last_scan_at FROM x
  UNION ALL SELECT 'nodes', graph_id::varchar, unnest(node_ids), last_updated FROM call_graphs),
refs AS (SELECT ref_field, owner_id, {_name('c')} AS ref_id, at_s FROM raw WHERE c IS NOT NULL AND trim(c) <> '')
"""

_ORPHAN_ENTRIES = """
SELECT '{t}' AS source_table, strftime({at}, '%Y-%m') AS month, count(entry_id) AS n_refs, count(*) FILTER (WHERE entry_id IS NOT NULL AND entry_id NOT IN (SELECT entry_id FROM ledger_entries)) AS n_missing
FROM {t} GROUP BY ALL"""

def _listed(table: str, key: str, column: str, path: str) -> str:
    return f"SELECT '{table}', {key}, '{path}', (p)::varchar FROM (SELECT {key}, unnest({column}) AS v, unnest(range(0, len({column}))) AS p FROM {table}) WHERE v IS NOT NULL"


_NODE_COLUMNS = " UNION ALL ".join(
    [
        _listed("func_nodes", "node_seq", "calls", "calls"),
        _listed("func_nodes", "node_seq", "called_by", "called_by"),
        "SELECT 'func_nodes', node_seq, 'taint_sig', '0' FROM func_nodes WHERE taint_sig IS NOT NULL",
        _listed("func_nodes", "node_seq", "taint_sig.sink_calls", "taint_sig.sink_calls"),
        _listed("func_nodes", "node_seq", "taint_sig.sanitized_paths", "taint_sig.sanitized_paths"),
        "SELECT 'func_nodes', node_seq, 'taint_sig.source_params', (e.key)::varchar FROM (SELECT node_seq, unnest(map_entries(taint_sig.source_params)) AS e FROM func_nodes) WHERE e.value IS NOT NULL",
        "SELECT 'func_nodes', node_seq, 'taint_sig.tainted_params', k || '/' || p FROM (SELECT node_seq, (e.key)::varchar AS k, unnest(e.value) AS v, unnest(range(0, len(e.value))) AS p FROM (SELECT node_seq, unnest(map_entries(taint_sig.tainted_params)) AS e FROM func_nodes)) WHERE v IS NOT NULL",
        "SELECT 'hook_inputs', input_id, 'tool_input', '0' FROM hook_inputs WHERE tool_input IS NOT NULL",
        "SELECT 'hook_inputs', input_id, 'tool_response', '0' FROM hook_inputs WHERE tool_response IS NOT NULL",
    ]
)



def _shredded(values: bool = False, fields: bool = False) -> str:
    """The children of ``raw_records`` by JSON functions: objects become lists of named members, parts sent as text are read. ``values``: those that are scalars, with their value; ``fields``: the scalar members of those that are objects."""

    def read(x: str) -> str:
        return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') AND json_type({x}->>'$') IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN ({x}->>'$')::json ELSE {x} END"

    def members(x: str) -> str:
        name = "lower(regexp_replace(regexp_replace(regexp_replace(trim(k), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '[-_ ]+', '_', 'g'))"
        return f"CASE WHEN json_type({x}) = 'OBJECT' THEN list_transform(json_keys({x}), lambda k: {{'n': {name}, 'k': k, 'v': json_extract({x}, '$.\"' || k || '\"')}}) ELSE [] END"

    def parts(rows: str, source: str, column: str, name: str, prefix: str) -> str:
        """``rows(record_id, pre, v)``: the elements of a list (or a lone one) that is a member of ``source.column``."""
        return f"""{rows}_0 AS (SELECT record_id, {prefix} AS pre, {read('m.v')} AS v FROM (SELECT record_id, pre, unnest({members(column)}) AS m FROM {source}) WHERE m.n = '{name}'),
{rows}_1 AS (SELECT record_id, pre, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'NULL' THEN [] ELSE [v] END AS vs FROM {rows}_0),
{rows} AS (SELECT record_id, pre || i AS pre, {read('v')} AS v FROM (SELECT record_id, pre, unnest(vs) AS v, unnest(range(0, len(vs))) AS i FROM {rows}_1) WHERE json_type(v) <> 'NULL')"""

    def one(rows: str, source: str, name: str) -> str:
        return f"{rows} AS (SELECT record_id, '' AS pre, {read('m.v')} AS v FROM (SELECT record_id, unnest({members('v')}) AS m FROM {source}) WHERE m.n = '{name}' AND json_type(m.v) <> 'NULL')"

    def entries(rows: str, name: str) -> str:
        return f"""{rows} AS (SELECT record_id, m.k AS k, m.v AS v FROM (SELECT record_id, unnest({members('v')}) AS m FROM (SELECT record_id, {read('m.v')} AS v FROM (SELECT record_id, unnest({members('v')}) AS m FROM sig) WHERE m.n = '{name}')) WHERE json_type(m.v) <> 'NULL')"""

    steps = [
        "r0 AS (SELECT record_id, payload::json AS v FROM raw_records WHERE json_valid(trim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13))))",
        f"r1 AS (SELECT record_id, {read('v')} AS v FROM r0)",
        f"r2 AS (SELECT record_id, {read('v')} AS v FROM r1)",
        "r AS (SELECT record_id, '' AS pre, v FROM r2 WHERE json_type(v) = 'OBJECT')",
        parts("fi", "r", "v", "findings", "pre"),
        parts("ta", "fi", "v", "tags", "pre || '/'"),
        f"fl AS (SELECT record_id, pre, {read('m.v')} AS v FROM (SELECT record_id, pre, unnest({members('v')}) AS m FROM fi) WHERE m.n = 'flow')",
        parts("st", "fl", "v", "steps", "pre || '/'"),
        *[parts(n, "r", "v", name, "pre") for n, name in (("su", "suppressed_rules"), ("ca", "calls"), ("cb", "called_by"))],
        one("sig", "r", "taint_sig"),
        *[parts(n, "sig", "v", name, "pre") for n, name in (("si", "sink_calls"), ("ss", "suppressed_sinks"), ("sp", "sanitized_paths"))],
        entries("so", "source_params"),
        entries("tp0", "tainted_params"),
        "tp1 AS (SELECT record_id, k, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END AS vs FROM tp0)",
        "tp AS (SELECT record_id, k || '/' || i AS pre, v FROM (SELECT record_id, k, unnest(vs) AS v, unnest(range(0, len(vs))) AS i FROM tp1) WHERE json_type(v) <> 'NULL')",
        one("ti", "r", "tool_input"),
        parts("ed", "ti", "v", "edits", "pre"),
        one("tr", "r", "tool_response"),
    ]
    places = {"findings": "fi", "findings.tags": "ta", "findings.flow.steps": "st", "suppressed_rules": "su", "calls": "ca", "called_by": "cb", "taint_sig.sink_calls": "si", "taint_sig.suppressed_sinks": "ss", "taint_sig.sanitized_paths": "sp", "taint_sig.tainted_params": "tp", "tool_input.edits": "ed"}
    places |= {"taint_sig": "sig", "tool_input": "ti", "tool_response": "tr", "taint_sig.source_params": "so"}
    at = {"sig": "'0'", "ti": "'0'", "tr": "'0'", "so": "k"}
    some, only = (", v->>'$' AS value", " WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')") if values else ("", "")
    if fields:
        inner = {"findings": "'tags', 'flow'", "taint_sig": "'sink_calls', 'suppressed_sinks', 'sanitized_paths', 'tainted_params', 'source_params'", "tool_input": "'edits'"}
        own = [f"""SELECT record_id, '{p}' AS child_path, pos_path, m.n AS field, m.v->>'$' AS scalar FROM (SELECT record_id, {at.get(n, 'pre')} AS pos_path, unnest({members('v')}) AS m FROM {n})
WHERE json_type(m.v) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND m.n NOT IN ({inner.get(p, "''")})""" for p, n in places.items()]
        return f"WITH {', '.join(steps)} {' UNION ALL '.join(own)}"
    rows = [f"SELECT record_id, '{p}' AS child_path, {at.get(n, 'pre')} AS pos_path{some} FROM {n}{only}" for p, n in places.items()]
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(rows)}"


ORACLE = {
    "p5_found": _shredded(),
    "p5_values": _shredded(values=True),
    "p5_fields": _shredded(fields=True),
    "p2_survivors": _survivors(),
    "p5_node_columns": f"SELECT * FROM ({_NODE_COLUMNS}) AS t(source_table, record_id, child_path, pos_path)",
    "p2_found": f"WITH {_FINDINGS} SELECT first_id, finding_id AS best_id FROM r WHERE place = 1 AND n_members > 1",
    "p4_found": f"WITH {_LEDGER} SELECT * FROM long",
    "p4_features": _features(),
    "p6_found": f"WITH {_GRAPH} SELECT DISTINCT ref_field, owner_id, ref_id AS missing_id FROM refs WHERE ref_id NOT IN (SELECT nid FROM x)",
    "p6_report": f"""WITH {_GRAPH}, one AS (SELECT ref_field, owner_id, ref_id, max(at_s) AS at_s FROM refs GROUP BY ALL)
SELECT ref_field, strftime(at_s, '%Y-%m') AS month, count(*) AS n_refs, count(*) FILTER (WHERE ref_id NOT IN (SELECT nid FROM x)) AS n_missing,
  count(*) FILTER (WHERE ref_id NOT IN (SELECT nid FROM x) AND ref_id IN (SELECT nid FROM s)) AS n_deleted FROM one GROUP BY ALL""",
    "p6_entries": _ORPHAN_ENTRIES.format(t="findings", at="recorded_at") + " UNION ALL " + _ORPHAN_ENTRIES.format(t="hook_inputs", at="received_at"),
}
