"""The keyed findings store: a merge of sightings into records with a life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.scoring import severity_label

ACTIVE, SUPPRESSED, RESOLVED = "active", "suppressed", "resolved"
#: A record's columns.
RECORD = "key string, rule_id string, file_path string, line_number int, title string, severity int, confidence_score double, cwe_id string, matched_text string, status string, first_seen timestamp, last_seen timestamp, count long, suppress_reason string"


def record_key(rule_id: Column, path: Column, matched: Column) -> Column:
    """24 hex digits of the SHA-256 of rule, path and the first 80 bytes of the match; line numbers don't count, they shift."""
    blank = F.lit("")
    head = F.substring(F.encode(F.coalesce(matched, blank), "UTF-8"), 1, 80)
    raw = F.concat(F.encode(F.concat(F.coalesce(rule_id, blank), F.lit("|"), F.coalesce(path, blank), F.lit("|")), "UTF-8"), head)
    return F.substring(F.sha2(raw, 256), 1, 24)


def sightings(findings: DataFrame, at: str) -> DataFrame:
    """``key`` and, per key, the first and last sighting, their number and the last one's values; ``suppressed`` of the last if there is such a column."""
    reason = F.col("suppress_reason") if "suppress_reason" in findings.columns else F.lit(None).cast("string")
    off = F.col("suppressed") if "suppressed" in findings.columns else F.lit(False)
    f = findings.withColumn("key", record_key(F.col("rule_id"), F.col("file_path"), F.col("matched_text")))
    last = F.struct(F.col(at), F.col("finding_id")) if "finding_id" in findings.columns else F.col(at)
    values = F.struct("rule_id", "file_path", "line_number", "title", "severity", "confidence_score", "cwe_id", "matched_text", off.alias("off"), reason.alias("suppress_reason"))
    return f.groupBy("key").agg(F.max_by(values, last).alias("v"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("count")).select("key", "v.*", F.col("first_seen").cast("timestamp"), F.col("last_seen").cast("timestamp"), "count")


def upsert(store: DataFrame, seen: DataFrame, scanned: DataFrame, at: Column) -> DataFrame:
    """The store after a scan: ``seen`` are its ``sightings``, ``scanned`` the files (``file_path``) it covered, ``at`` its time.

    New keys are added; known ones get the new line, title, match, score and count, and a resolved one is active again, while a
    suppressed one stays so; active records of scanned files that weren't seen are resolved. One full join on the key.
    """
    s, n = store.alias("s"), seen.alias("n")
    files = scanned.select("file_path").distinct().withColumn("__scanned", F.lit(True))
    both = s.join(n, F.col("s.key") == F.col("n.key"), "full")
    new, old = F.col("n.key").isNotNull(), F.col("s.key").isNotNull()
    merged = both.select(
        F.coalesce("s.key", "n.key").alias("key"),
        F.coalesce("s.rule_id", "n.rule_id").alias("rule_id"),
        F.coalesce("s.file_path", "n.file_path").alias("file_path"),
        F.when(new, F.col("n.line_number")).otherwise(F.col("s.line_number")).alias("line_number"),
        F.when(new, F.col("n.title")).otherwise(F.col("s.title")).alias("title"),
        F.coalesce("s.severity", "n.severity").alias("severity"),
        F.when(new, F.col("n.confidence_score")).otherwise(F.col("s.confidence_score")).alias("confidence_score"),
        F.coalesce("s.cwe_id", "n.cwe_id").alias("cwe_id"),
        F.when(new, F.col("n.matched_text")).otherwise(F.col("s.matched_text")).alias("matched_text"),
        F.when(new & F.col("n.off"), SUPPRESSED).when(new & old & (F.col("s.status") == SUPPRESSED), SUPPRESSED).when(new, ACTIVE).otherwise(F.col("s.status")).alias("status"),
        F.coalesce("s.first_seen", "n.first_seen").alias("first_seen"),
        F.when(new, F.col("n.last_seen")).otherwise(F.col("s.last_seen")).alias("last_seen"),
        (F.coalesce("s.count", F.lit(0)) + F.coalesce("n.count", F.lit(0))).alias("count"),
        F.when(new & F.col("n.off"), F.col("n.suppress_reason")).otherwise(F.col("s.suppress_reason")).alias("suppress_reason"),
        new.alias("__seen"),
    )
    done = merged.join(files, "file_path", "left")
    gone = (F.col("status") == ACTIVE) & ~F.col("__seen") & F.coalesce("__scanned", F.lit(False))
    return done.withColumns({"status": F.when(gone, RESOLVED).otherwise(F.col("status")), "last_seen": F.when(gone, at).otherwise(F.col("last_seen"))}).select("key", "rule_id", "file_path", "line_number", "title", "severity", "confidence_score", "cwe_id", "matched_text", "status", "first_seen", "last_seen", "count", "suppress_reason")


def summary(store: DataFrame) -> DataFrame:
    """Records per status and severity."""
    return store.groupBy("status", severity_label(F.col("severity")).alias("severity_label")).agg(F.count(F.lit(1)).alias("n_records"), F.sum("count").alias("n_sightings"))


def listing(store: DataFrame, status: str | None = None) -> DataFrame:
    """Records of a status (all if None), the most severe first, then by path."""
    rows = store if status is None else store.where(F.col("status") == status)
    return rows.orderBy(F.desc("severity"), "file_path", "key")
