"""Call graphs on disk: one JSON document per graph, read with the rules for stale and broken ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a caller's file from which it isn't read for the analysis.
MAX_CALLER = 2 * 1024 * 1024
NODE = "id string, file_path string, name string, package string, start_line int, end_line int, calls array<string>, called_by array<string>, content_hash string, language string, finding_count int"
GRAPH = f"project_root string, session_id string, last_updated string, version int, nodes map<string,struct<{NODE.replace(' ', ':').replace(',:', ',')}>>"


def save(graph: DataFrame, nodes: DataFrame, folder: str) -> None:
    """Writes one JSON line per graph (``project_root, session_id, last_updated, version``) with its ``nodes`` (``NODE`` and ``project_root``); the old files stay until all are written."""
    held = nodes.groupBy("project_root").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct(*[c.split()[0] for c in NODE.split(", ")])))).alias("nodes"))
    rows = graph.join(held, "project_root", "left").select("project_root", "session_id", "last_updated", "version", "nodes")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(folder)


def load(spark: SparkSession, folder: str, session_id: str) -> DataFrame:
    """``project_root`` and ``NODE`` of the graphs of ``folder`` that belong to a session; graphs of other sessions are stale, and broken documents are empty graphs: neither has nodes."""
    parsed = spark.read.text(folder, wholetext=False).select(F.from_json("value", GRAPH, {"mode": "PERMISSIVE"}).alias("g"))
    own = parsed.where((F.col("g.session_id") == session_id) & F.col("g.nodes").isNotNull())
    return own.select(F.col("g.project_root").alias("project_root"), F.explode("g.nodes").alias("key", "n")).select("project_root", "n.*")


def caller_files(callers: DataFrame, functions: DataFrame, files: DataFrame, most: int = MAX_CALLER) -> DataFrame:
    """``callers`` (``start, caller, ...``) with the ``content`` of the file each caller is in; callers in files that are gone or longer than ``most`` are left out."""
    where = functions.select(F.col("id").alias("caller"), "file_path")
    read = files.where(F.octet_length("content") <= most).select(F.col("path").alias("file_path"), "content")
    return callers.join(where, "caller").join(read, "file_path")
