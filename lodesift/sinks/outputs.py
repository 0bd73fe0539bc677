"""Sinks: the append-only ledger, the findings store, the hook's answers and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.scoring import blocks, severity_icon, severity_label
from lodesift.functions.text import truncated


def ledger_rows(decisions: DataFrame, at: Column) -> DataFrame:
    """A ledger entry per scan from ``fusion.decisions``."""
    names = F.array(*[F.lit(x) for x in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")])
    return decisions.select(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        "*",
        F.coalesce(F.get(names, F.col("max_severity")), F.lit("UNKNOWN")).alias("max_severity_label"),
        F.to_date(at).alias("date"),
    )


def append_ledger(entries: DataFrame, folder: str) -> None:
    """Appends entries as JSON lines, a folder per day (``date``)."""
    entries.write.mode("append").partitionBy("date").json(folder)


def save_store(store: DataFrame, folder: str) -> None:
    """Replaces the store, the most severe records first, then by path; readers see the old files until the new ones are complete.

    The order is one over ranges, so that it holds over the files of the folder without any task holding all.
    """
    store.orderBy(F.desc("severity"), "file_path", "key").write.mode("overwrite").parquet(folder)


def _place() -> Column:
    return F.when(F.col("line_number") > 0, F.concat("file_path", F.lit(":"), F.col("line_number").cast("string"))).otherwise(F.col("file_path"))


def short_text() -> Column:
    """A finding in one line: its severity's sign, rule, title and place."""
    return F.concat(F.lit("["), severity_icon(F.col("severity")), F.lit("] "), F.col("rule_id"), F.lit(": "), F.coalesce("title", F.lit("")), F.lit(" ("), _place(), F.lit(")"))


def detail_text() -> Column:
    """A finding in several lines; what is blank has none. The columns are those of a finding."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"  {name}"), value))

    head = F.concat(F.lit("["), severity_label(F.col("severity")), F.lit("] "), F.col("rule_id"), F.lit(": "), F.coalesce("title", F.lit("")))
    score = F.when(F.col("confidence_score") > 0, F.concat(F.format_number(F.col("confidence_score") * 100, 0), F.lit("%")))
    return F.concat_ws(
        "\n",
        head,
        line("File: ", _place()),
        line("Match: ", truncated(F.col("matched_text"), 120)),
        line("", F.col("description")),
        line("Fix: ", F.col("suggestion")),
        line("CWE: ", F.col("cwe_id")),
        line("OWASP: ", F.col("owasp_category")),
        line("Confidence: ", score),
    )


def block_messages(findings: DataFrame, scan: str = "entry_id") -> DataFrame:
    """``scan, file_path, message`` of the files whose write is blocked: the findings that block, each with its place and what to do."""
    stop = findings.where(blocks(F.col("severity"), F.col("confidence_score")))
    one = F.array_sort(F.collect_list(F.struct((-F.col("confidence_score")).alias("s"), "line_number", detail_text().alias("text"))))
    return stop.groupBy(scan, "file_path").agg(F.array_join(F.transform(one, lambda x: x["text"]), "\n\n").alias("__all")).select(
        scan, "file_path", F.concat(F.lit("The write was stopped: a critical weakness that is all but certain.\n\n"), "__all", F.lit("\n\nMend it before writing this file.")).alias("message")
    )


def hook_answers(decisions: DataFrame, context: Column) -> DataFrame:
    """The JSON answer per scan, and the exit code: 2 blocks."""
    body = F.to_json(F.struct(F.struct(context.alias("additionalContext")).alias("hookSpecificOutput")))
    return decisions.select("*", body.alias("answer"), F.when(F.col("blocked"), 2).otherwise(0).alias("exit_code"))


def reports(findings: DataFrame, scan: str = "entry_id") -> DataFrame:
    """One text per scan: a line per finding, the most severe first, and the counts by severity."""
    line = F.format_string("[%s] %s %s:%d %s", F.coalesce("severity_label", F.lit("UNKNOWN")), F.coalesce("rule_id", F.lit("?")), F.coalesce("file_path", F.lit("?")), F.coalesce("line_number", F.lit(0)), F.coalesce(truncated(F.col("matched_text"), 120), F.lit("")))
    rows = findings.select(scan, "severity", line.alias("line"))
    one = F.array_sort(F.collect_list(F.struct((-F.coalesce("severity", F.lit(-1))).alias("s"), "line")))
    return rows.groupBy(scan).agg(F.count(F.lit(1)).alias("n_findings"), F.array_join(F.transform(one, lambda x: x["line"]), "\n").alias("report"))
