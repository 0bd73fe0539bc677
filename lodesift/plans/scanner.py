"""Queries of the scanner's own operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions import paths
from lodesift.functions.text import stripped
from lodesift.operators import callgraph, comments, fusion, graphbuild, hints, interproc, lines, pyast, pyflow, rules, scan, store, suppress, taint
from lodesift.plans.rule_table import RULES
from lodesift.sinks import outputs
from lodesift.sources import events
from lodesift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _files(spark: SparkSession, d: str) -> DataFrame:
    return events.files(table(spark, d, "hook_inputs"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """The raw findings with ids as the reference writes them: trimmed upper case rules, ``CWE-<n>`` or nothing."""
    n = F.nullif(F.regexp_extract("cwe_id", r"0*(\d{1,9})", 1), F.lit(""))
    return table(spark, d, "findings").withColumns({"rule_id": F.upper(stripped(F.col("rule_id"))), "cwe_id": F.coalesce(F.concat(F.lit("CWE-"), n), F.lit("")), "confidence": F.lower(stripped(F.col("confidence")))})


def files(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("input_id", "path", "lang", F.char_length("content").alias("n_chars"), "is_new")


def events_read(spark: SparkSession, d: str) -> DataFrame:
    """The events, written as JSON lines and read again."""
    fields = ["session_id", "cwd", "hook_event_name", "tool_name", "tool_input", "tool_response", "tool_use_id"]
    lines_ = table(spark, d, "hook_inputs").select(F.to_json(F.struct(*fields)).alias("value"))
    e = events.parse_events(lines_, "value")
    return e.select("session_id", "cwd", "hook_event_name", "tool_name", "tool_use_id", events.event_path().alias("path"), F.md5(events.event_content()).alias("content_md5"), F.col("tool_response.success").alias("success"), F.col("corrupt").isNotNull().alias("corrupt"))


def scan_contents(spark: SparkSession, d: str) -> DataFrame:
    """Before the tool ran the event's content counts, after it that on disk: here, what the last Write to the path left there."""
    hooks = table(spark, d, "hook_inputs")
    writes = hooks.where((F.col("tool_name") == "Write") & (F.col("tool_input.content") != "")).select("input_id", events.event_path().alias("path"), F.col("tool_input.content").alias("content"))
    disk = writes.where("path IS NOT NULL").groupBy("path").agg(F.max_by("content", "input_id").alias("content"))
    return events.files(hooks, disk).select("input_id", "path", F.md5("content").alias("content_md5"))


def generated_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that were generated, by path or by a mark in their first 2,048 characters; the imports here stand in for marks, of which the tables have none."""
    f = _files(spark, d).withColumn("content", F.regexp_replace("content", r"^import logging", "# Code generated by hand, do not edit\nimport logging"))
    return f.select("input_id", paths.is_generated(F.col("path")).alias("by_path"), paths.is_generated(F.col("path"), F.col("content")).alias("generated"))


def lines_explode(spark: SparkSession, d: str) -> DataFrame:
    return lines.lines(_files(spark, d), "input_id")


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "ledger_entries").select("file_path").distinct()
    return p.select("file_path", paths.language(F.col("file_path")).alias("detected"))


def path_filters(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "ledger_entries").select("file_path").distinct()
    c = F.col("file_path")
    return p.select(c, paths.is_generated(c).alias("generated"), paths.is_vendored(c).alias("vendored"), paths.is_test(c).alias("test"), paths.is_scannable(c).alias("scannable"))


def comment_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.comment_counts(_files(spark, d), "input_id")


def continuation_join(spark: SparkSession, d: str) -> DataFrame:
    return lines.joined(_files(spark, d).where(F.col("lang").isin(*lines.CONTINUED)), "input_id")


def python_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.joined_python(_files(spark, d).where("lang = 'python'"), "input_id")


def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.apply(_files(spark, d), RULES, "input_id").withColumn("tags", F.array_join("tags", ","))


def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.apply(_files(spark, d), RULES, "input_id").groupBy("rule_id", "confidence").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("input_id").alias("n_files"))


def dedup_findings(spark: SparkSession, d: str) -> DataFrame:
    m = fusion.merged(_findings(spark, d))
    return m.select("finding_id", "entry_id", "file_path", "line_number", "cwe_id", "rule_id", "severity", "tier", F.round("confidence_score", 6).alias("confidence_score"), F.array_join(F.array_sort("tags"), ",").alias("tags"), "n_merged")


def test_downgrade(spark: SparkSession, d: str) -> DataFrame:
    f = fusion.downgraded(fusion.scored(_findings(spark, d)))
    return f.select("finding_id", "severity", "severity_label", F.round("confidence_score", 6).alias("confidence_score"), "confidence", F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "test-file").alias("is_test"))


def block_decision(spark: SparkSession, d: str) -> DataFrame:
    return fusion.decisions(fusion.downgraded(fusion.merged(_findings(spark, d))))


def category_summary(spark: SparkSession, d: str) -> DataFrame:
    return fusion.categories(fusion.scored(_findings(spark, d)))


def findings_store(spark: SparkSession, d: str) -> DataFrame:
    """The store after two scans: all findings up to October, then those after, over the files of the second."""
    f = _findings(spark, d)
    empty = spark.createDataFrame([], store.RECORD)
    border = F.lit("2025-10-15 00:00:00").cast("timestamp_ntz")
    first = f.where(F.col("recorded_at") < border)
    second = f.where(F.col("recorded_at") >= border)
    at = F.lit("2025-12-01 00:00:00").cast("timestamp")
    one = store.upsert(empty, store.sightings(first, "recorded_at"), first, at)
    return store.upsert(one, store.sightings(second, "recorded_at"), second, at).select("key", "rule_id", "file_path", "line_number", "severity", "status", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "count")


def ledger_daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ledger_entries")
    return e.groupBy(F.to_date("received_at").cast("string").alias("day"), F.lower(stripped(F.col("event"))).alias("event")).agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_if(F.coalesce("blocked", F.lit(False))).alias("n_blocked"), F.sum(F.coalesce("finding_count", F.lit(0))).alias("n_findings"), F.max("scan_time_ms").alias("max_scan_ms")
    )


def reports(spark: SparkSession, d: str) -> DataFrame:
    return outputs.reports(_findings(spark, d)).select("entry_id", "n_findings", F.md5("report").alias("report_md5"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.edges(callgraph.functions(table(spark, d, "func_nodes")))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    f = callgraph.functions(table(spark, d, "func_nodes"))
    return callgraph.stats(f, callgraph.edges(f))


def _starts(spark: SparkSession, d: str) -> DataFrame:
    """The query set: functions with a version whose ``node_seq`` is divisible by 100, against all functions."""
    from lodesift.operators.orphans import node_name

    return table(spark, d, "func_nodes").where("node_seq % 100 = 0").select(node_name(F.col("id")).alias("id")).distinct()


def transitive_callers(spark: SparkSession, d: str) -> DataFrame:
    from lodesift.session import cut

    e = cut(graph_edges(spark, d))
    f = callgraph.functions(table(spark, d, "func_nodes")).select("id")
    return callgraph.callers(e, _starts(spark, d).join(f, "id", "left_semi"))


def impacted_callers(spark: SparkSession, d: str) -> DataFrame:
    from lodesift.session import cut

    f = callgraph.functions(table(spark, d, "func_nodes"))
    return callgraph.impacted(f, cut(callgraph.edges(f)), _starts(spark, d))


def signature_changes(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.changes(table(spark, d, "func_nodes"))


def interproc_arguments(spark: SparkSession, d: str) -> DataFrame:
    f = callgraph.functions(table(spark, d, "func_nodes"))
    return callgraph.tainted_arguments(f, callgraph.edges(f))


def called_names(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.called_names(_files(spark, d), "input_id")


def function_scopes(spark: SparkSession, d: str) -> DataFrame:
    return taint.function_scopes(_files(spark, d), "input_id")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """The files with one name for all their arguments: the snippets of the tables never use what they set, so nothing would flow in them."""
    return _files(spark, d).withColumn("content", F.regexp_replace("content", r"\barg_\w+", "arg_x"))


def _directed(df: DataFrame) -> DataFrame:
    """The files with directives, which the tables have none of: above each query of theirs, and around each loop's line."""
    above = F.regexp_replace("content", r"(?m)^([ \t]*)(.*SELECT .*)$", "$1# scan:ignore injection -- reviewed\n$1$2")
    return df.withColumn("content", F.regexp_replace(above, r"(?m)^([ \t]*for .*)$", "# scan:ignore-start all PY-014 -- a loop\n$1\n# scan:ignore-end"))


def taint_flows(spark: SparkSession, d: str) -> DataFrame:
    return taint.flows(_linked(spark, d), "input_id").withColumn("steps", F.size("steps"))


def python_flows(spark: SparkSession, d: str) -> DataFrame:
    return pyflow.flows(_linked(spark, d), "input_id").withColumn("steps", F.size("steps"))


def flow_reports(spark: SparkSession, d: str) -> DataFrame:
    return taint.report(taint.flows(_linked(spark, d), "input_id")).select("input_id", "scope", "line_number", "sink_id", "report")


def _calling(df: DataFrame) -> DataFrame:
    """The Python files with one more function, that calls the first of theirs with foreign data: their own functions never call each other."""
    name = F.regexp_extract("content", r"def (\w+)\([^)]*\barg_x\b", 1)
    more = F.concat("content", F.lit("\ndef handle_linked():\n    got = request.args.get('q')\n    return "), name, F.lit("(got)\n"))
    return df.withColumn("content", F.when((F.col("lang") == "python") & (name != ""), more).otherwise(F.col("content")))


def interproc_flows(spark: SparkSession, d: str) -> DataFrame:
    return interproc.flows(_calling(_linked(spark, d)), "input_id")


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """The files whose arguments are linked, with a calling function and directives, written once for the layers that read them."""
    from lodesift.session import cut

    return cut(_directed(_calling(_linked(spark, d))).select("input_id", "path", "lang", "content"))


def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    """The whole scan of files whose arguments are linked and that have directives."""
    f = scan.findings(_scanned(spark, d), "input_id", RULES)
    return f.select("input_id", "file_path", "line_number", "cwe_id", "rule_id", "layer", "severity", "severity_label", F.round("confidence_score", 6).alias("confidence_score"), "confidence", F.array_join(F.array_sort("tags"), ",").alias("tags"), "n_merged", "suppressed", "suppress_reason")


def scan_decisions(spark: SparkSession, d: str) -> DataFrame:
    found = scan.findings(_scanned(spark, d), "input_id", RULES)
    return scan.decisions(found, "input_id").withColumn("suppressed_rules", F.array_join("suppressed_rules", ","))


def python_tree(spark: SparkSession, d: str) -> DataFrame:
    return pyast.findings(_files(spark, d), "input_id").drop("tags")


def suppressions(spark: SparkSession, d: str) -> DataFrame:
    return suppress.covered(_directed(_files(spark, d)), "input_id")


def finding_texts(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d)
    return f.select("finding_id", outputs.short_text().alias("short"), F.md5(outputs.detail_text()).alias("detail_md5"))


def python_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by kind in every Python file."""
    return pyast.nodes(_files(spark, d), "input_id").groupBy("input_id", "kind").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("last_line").alias("last_line"))


def caller_hints(spark: SparkSession, d: str) -> DataFrame:
    f = callgraph.functions(table(spark, d, "func_nodes"))
    return hints.caller_hints(impacted_callers(spark, d), f).withColumn("affected", F.array_join("affected", ","))


def architecture_hints(spark: SparkSession, d: str) -> DataFrame:
    return hints.hints(_findings(spark, d)).where("kind = 'architecture'").drop("line_number")


def comment_spans(spark: SparkSession, d: str) -> DataFrame:
    return comments.spans(_files(spark, d), "input_id")


def uncommented_findings(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return comments.outside(rules.apply(f, RULES, "input_id"), f, "input_id").select("input_id", "rule_id", "line_number", "matched_text")


def built_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graphbuild.nodes(_files(spark, d), "input_id").withColumn("calls", F.array_join("calls", ","))


def built_signatures(spark: SparkSession, d: str) -> DataFrame:
    return graphbuild.signatures(_files(spark, d), "input_id").withColumn("sink_calls", F.size("sink_calls"))


def interproc_returns(spark: SparkSession, d: str) -> DataFrame:
    """Over the Python files with two more functions, one of which returns foreign data to the other: their own never call each other."""
    more = "\ndef fetch_linked():\n    return request.args.get('q')\n\ndef use_linked():\n    got = fetch_linked()\n    kept = 1\n    cur.execute('SELECT a FROM t WHERE b = ' + got)\n"
    f = _files(spark, d).withColumn("content", F.when(F.col("lang") == "python", F.concat("content", F.lit(more))).otherwise(F.col("content")))
    return graphbuild.tainted_returns(f, "input_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        files, events_read, scan_contents, generated_files, lines_explode, language_detect, path_filters, comment_lines, continuation_join, python_lines, rule_findings, rule_counts, dedup_findings, test_downgrade, block_decision, category_summary,
        findings_store, ledger_daily, reports, graph_edges, graph_stats, transitive_callers, impacted_callers, signature_changes, interproc_arguments, called_names, function_scopes, taint_flows,
        python_tree, python_flows, flow_reports, interproc_flows, scan_findings, scan_decisions, suppressions, finding_texts, python_nodes, caller_hints, architecture_hints, comment_spans, uncommented_findings, built_nodes, built_signatures, interproc_returns,
    )
}
