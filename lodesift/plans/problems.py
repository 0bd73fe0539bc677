"""The pN_ queries of the core problems."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions.scoring import tier
from lodesift.functions.text import label, stripped
from lodesift.functions.times import epoch_seconds
from lodesift.operators import entity_features, orphans, shred, survivors
from lodesift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def cwe_number(c: Column) -> Column:
    """The number in a CWE id of any spelling, or null."""
    return F.nullif(F.regexp_extract(c, r"0*(\d{1,18})", 1), F.lit("")).try_cast("bigint")


def _blank_as_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def finding_survivors(findings: DataFrame, fill: bool = True) -> DataFrame:
    """The surviving finding per issue (entry, file, line, CWE number), with its blank fields filled if ``fill``."""
    rule = F.upper(stripped(F.col("rule_id")))
    sure = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (("high", 3), ("medium", 2), ("low", 1)) for x in kv]), label(F.col("confidence"))), F.lit(0))
    cwe = cwe_number(F.col("cwe_id"))
    df = findings.withColumns({"cwe_number": cwe, "line_number": F.nullif(F.col("line_number"), F.lit(0))})
    return survivors.survivors(
        df,
        ["entry_id", "file_path", "line_number", "cwe_number"],
        "finding_id",
        "recorded_at",
        [tier(F.col("tags"), rule), F.coalesce(F.col("severity"), F.lit(-1)), sure, survivors.descending(rule)],
        {
            "rule_id": F.nullif(rule, F.lit("")),
            "severity_label": _blank_as_null(F.col("severity_label")),
            "title": _blank_as_null(F.col("title")),
            "description": _blank_as_null(F.col("description")),
            "col_no": F.col("col_no"),
            "matched_text": F.nullif(F.col("matched_text"), F.lit("")),
            "suggestion": _blank_as_null(F.col("suggestion")),
            "owasp_category": _blank_as_null(F.col("owasp_category")),
            "lang": F.nullif(label(F.col("lang")), F.lit("")),
            "confidence": F.nullif(label(F.col("confidence")), F.lit("")),
            "confidence_score": F.nanvl(F.col("confidence_score"), F.lit(None).cast("double")),
        },
        fill,
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return finding_survivors(table(spark, d, "findings"), fill=False).select("first_id", "best_id")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return finding_survivors(table(spark, d, "findings")).withColumn("filled_from", F.to_json("filled_from"))


def ledger_events(ledger: DataFrame) -> DataFrame:
    """The ledger's entries, each once: ``session_id, at, event, file_path, kind, blocked, finding_count``."""
    rows = ledger.select(
        label(F.col("session_id")).alias("session_id"),
        epoch_seconds(F.col("logged_at")).alias("at"),
        label(F.col("event")).alias("event"),
        "file_path",
        F.concat_ws("/", F.coalesce(label(F.col("event")), F.lit("")), F.coalesce(label(F.col("lang")), F.lit("*")), F.coalesce(label(F.col("max_severity")), F.lit(""))).alias("event_type"),
        F.coalesce(F.col("blocked"), F.lit(False)).alias("blocked"),
        F.coalesce(F.col("finding_count"), F.lit(0)).alias("finding_count"),
        "entry_id",
    ).where((F.col("session_id") != "") & F.col("at").isNotNull())
    return entity_features.once(rows, ["session_id", "at", "event", "file_path"], F.col("entry_id"))


def session_types(ledger: DataFrame) -> DataFrame:
    """The long table of sessions and event types."""
    return entity_features.long_features(
        ledger_events(ledger),
        "session_id",
        "event_type",
        {
            "n_entries": F.count(F.lit(1)),
            "n_blocked": F.sum(F.col("blocked").cast("bigint")),
            "n_findings": F.sum(F.col("finding_count").cast("bigint")),
            "last_epoch": F.max("at"),
        },
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return session_types(table(spark, d, "ledger_entries"))


#: The event types that have columns of their own, as a rule: every event, language and severity.
EVENTS = ("pretooluse", "posttooluse")
LANGUAGES = ("*", "c", "cpp", "csharp", "dockerfile", "go", "groovy", "java", "javascript", "json", "kotlin", "lua", "perl", "php", "python", "ruby", "rust", "shell", "swift", "terraform", "typescript", "yaml", "zig")
SEVERITIES = ("unknown", "info", "low", "medium", "high", "critical")
EVENT_TYPES = ["/".join(x) for x in product(EVENTS, LANGUAGES, SEVERITIES)]


def p4_features(spark: SparkSession, d: str) -> DataFrame:
    long = session_types(table(spark, d, "ledger_entries"))
    return entity_features.feature_table(long, "session_id", "event_type", ["n_entries", "n_blocked", "n_findings", "last_epoch"], EVENT_TYPES, recency_of="last_epoch")


def _raw_nodes(spark: SparkSession, d: str) -> DataFrame:
    return shred.adjacency(table(spark, d, "raw_records"), "record_id", "payload")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.entities(_raw_nodes(spark, d)).select("record_id", "child_path", "pos_path")


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """All entities of all places from one parse, with their fields as a map."""
    return shred.entities(_raw_nodes(spark, d)).withColumn("fields", F.to_json("fields"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """The children that are scalars themselves, with their values."""
    return shred.entities(_raw_nodes(spark, d)).where("value IS NOT NULL").select("record_id", "child_path", "pos_path", "value")


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    """The scalar members of the children that are objects, a row each; those of objects within them are in the flat tables only."""
    each = shred.entities(_raw_nodes(spark, d)).select("record_id", "child_path", "pos_path", F.explode("fields").alias("field", "scalar"))
    return each.where(~F.col("field").rlike(r"[.\[~]") & ~F.col("scalar").isin("{}", "[]"))


def _entity_query(place: str, fields: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return shred.entity(_raw_nodes(spark, d), place, fields).withColumn("rest", F.to_json("rest"))

    return query


def _record_query(kind: str, fields: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        records = table(spark, d, "raw_records").where(label(F.col("record_kind")) == kind)
        return shred.roots(shred.adjacency(records, "record_id", "payload"), fields).withColumn("rest", F.to_json("rest"))

    return query


#: Scalar fields of the flat table of each kind of record; all others are in its ``rest``.
RECORD_FIELDS = {
    "entry": ("timestamp", "session_id", "event", "file_path", "language", "finding_count", "suppressed_count", "max_severity", "blocked", "rules_run", "scan_time_ms"),
    "funcnode": ("id", "name", "file_path", "package", "start_line", "end_line", "content_hash", "last_scan_at", "language", "finding_count"),
    "input": ("session_id", "transcript_path", "cwd", "permission_mode", "hook_event_name", "tool_name", "tool_use_id"),
}
#: Scalar fields of each place's flat table; all others are in its ``rest``.
ENTITY_FIELDS = {
    "findings": ("rule_id", "severity", "severity_label", "title", "description", "file_path", "line_number", "column", "matched_text", "suggestion", "cwe_id", "owasp_category", "language", "confidence", "confidence_score", "flow.scope", "flow.confidence"),
    "findings.tags": (),
    "findings.flow.steps": ("line", "description", "var"),
    "suppressed_rules": (),
    "calls": (),
    "called_by": (),
    "taint_sig": ("is_pure",),
    "taint_sig.sink_calls": ("category", "method", "line", "arg_from_param"),
    "taint_sig.suppressed_sinks": ("category", "method", "line", "arg_from_param"),
    "taint_sig.sanitized_paths": ("param_index", "sink_category", "sanitizer", "line"),
    "taint_sig.tainted_params": (),
    "taint_sig.source_params": (),
    "tool_input": ("file_path", "content", "old_string", "new_string", "replace_all", "notebook_path", "new_source"),
    "tool_input.edits": ("old_string", "new_string", "replace_all"),
    "tool_response": ("success", "file_path"),
}


def p5_node_columns(spark: SparkSession, d: str) -> DataFrame:
    """The nested columns of ``func_nodes`` and ``hook_inputs``, taken apart as columns."""
    sig = {place: (place, how) for place, how in shred.PLACES.items() if place in ("calls", "called_by") or (place.startswith("taint_sig") and place != "taint_sig.suppressed_sinks")}
    fn = shred.column_parts(table(spark, d, "func_nodes"), "node_seq", sig)
    hi = shred.column_parts(table(spark, d, "hook_inputs"), "input_id", {p: (p, "one") for p in ("tool_input", "tool_response")})
    return fn.select(F.lit("func_nodes").alias("source_table"), "*").unionByName(hi.select(F.lit("hook_inputs").alias("source_table"), "*"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "func_nodes"), table(spark, d, "call_graphs"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(table(spark, d, "func_nodes"), table(spark, d, "call_graphs"))


def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    """Findings and hook events whose ``entry_id`` the ledger doesn't have, per table and month."""
    entries = table(spark, d, "ledger_entries").select("entry_id")

    def of(name: str, at: str) -> DataFrame:
        df = table(spark, d, name).select("entry_id", F.col(at).alias("at"))
        gone = orphans.missing_keys(entries, "entry_id", df, "entry_id").withColumnRenamed("key", "entry_id").withColumn("gone", F.lit(1))
        return df.join(gone, "entry_id", "left").groupBy(F.lit(name).alias("source_table"), F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("entry_id").alias("n_refs"), F.count("gone").alias("n_missing"))

    return of("findings", "recorded_at").unionByName(of("hook_inputs", "received_at"))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_survivors": p2_survivors,
    "p4_found": p4_found,
    "p4_features": p4_features,
    "p5_found": p5_found,
    "p5_entities": p5_entities,
    "p5_values": p5_values,
    "p5_fields": p5_fields,
    **{f"p5_records_{kind}": _record_query(kind, fields) for kind, fields in RECORD_FIELDS.items()},
    **{f"p5_{place.replace('.', '_')}": _entity_query(place, fields) for place, fields in ENTITY_FIELDS.items()},
    "p5_node_columns": p5_node_columns,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_entries": p6_entries,
}
