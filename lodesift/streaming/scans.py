"""The event-at-a-time life of the hook as micro-batches: scan, merge into the store, append to the ledger."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodesift.operators import fusion, rules, scan, store
from lodesift.sinks import outputs
from lodesift.sources.events import files


def delivered_once(batch: DataFrame, key: str) -> DataFrame:
    """Events delivered again under one ``key`` come once. An event without key has its own content as key, so that others like it stay apart."""
    whole = F.concat(F.lit("no-key-"), F.sha2(F.to_json(F.struct(*[c for c in batch.columns if c != key])), 256))
    return batch.withColumn(key, F.coalesce(F.col(key), whole)).dropDuplicates([key])


def scanned(the_files: DataFrame, table: Sequence[rules.Rule], key: str = "tool_use_id") -> DataFrame:
    """The findings of all layers of a batch's files, without the suppressed."""
    return scan.findings(the_files, key, table).where("NOT suppressed")


def merge_batch(spark: SparkSession, table: Sequence[rules.Rule], folder: str, key: str = "tool_use_id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function; each batch reads the version of the store before it and writes its own, so a batch that runs again replaces what it wrote."""

    def run(batch: DataFrame, number: int) -> None:
        the_files = files(delivered_once(batch, key), key=key).persist()
        found = scanned(the_files, table, key).withColumn("seen_at", F.current_timestamp()).persist()
        at = F.current_timestamp()
        before = spark.read.parquet(f"{folder}/store/{number - 1}") if number else spark.createDataFrame([], store.RECORD)
        paths = the_files.select(F.col("path").alias("file_path"))
        outputs.save_store(store.upsert(before, store.sightings(found, "seen_at"), paths, at), f"{folder}/store/{number}")
        outputs.ledger_rows(fusion.decisions(found, key), at).write.mode("overwrite").json(f"{folder}/ledger/{number}")
        for df in (found, the_files):
            df.unpersist()

    return run


def start(events: DataFrame, table: Sequence[rules.Rule], folder: str, checkpoint: str, key: str = "tool_use_id") -> StreamingQuery:
    """Runs the scan over a stream of events until all that is there has been read."""
    return events.writeStream.foreachBatch(merge_batch(events.sparkSession, table, folder, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_counts(ledger: DataFrame, late: str = "1 hour", size: str = "15 minutes") -> DataFrame:
    """Entries and findings per session and window of a stream of ledger entries, with a watermark for late ones."""
    return ledger.withWatermark("received_at", late).groupBy(F.window("received_at", size), "session_id").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("finding_count").alias("n_findings"))
