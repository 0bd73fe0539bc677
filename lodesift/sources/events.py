"""Events of the editing hook, as JSON lines or as a table, and the file rows made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions.paths import language
from lodesift.functions.text import lf

EVENT = (
    "session_id string, transcript_path string, cwd string, permission_mode string, hook_event_name string, tool_name string, "
    "tool_input struct<file_path:string,content:string,old_string:string,new_string:string,replace_all:boolean,notebook_path:string,new_source:string>, "
    "tool_response struct<filePath:string,success:boolean>, tool_use_id string"
)
#: Longest event in bytes; longer ones are reported, not read.
MAX_EVENT = 50 * 1024 * 1024


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Events from a folder of JSON lines, ``EVENT`` with ``corrupt`` (the line where it can't be read or is too long)."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return parse_events(lines, "value")


def parse_events(df: DataFrame, column: str) -> DataFrame:
    """The events in a text column; a line that can't be read or is too long gives nulls and ``corrupt``."""
    fits = F.octet_length(column) <= MAX_EVENT
    parsed = F.from_json(F.when(fits, F.col(column)), EVENT + ", corrupt string", {"columnNameOfCorruptRecord": "corrupt"})
    return df.select(parsed.alias("__e"), F.when(~fits, F.left(F.col(column), F.lit(200))).alias("__long")).select("__e.*", "__long").withColumn("corrupt", F.coalesce("corrupt", "__long")).drop("__long")


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def event_path() -> Column:
    return _first(F.col("tool_input.file_path"), F.col("tool_input.notebook_path"), F.col("tool_response.filePath"))


def event_content() -> Column:
    return _first(F.col("tool_input.content"), F.col("tool_input.new_string"), F.col("tool_input.new_source"))


def files(events: DataFrame, disk: DataFrame | None = None, key: str = "input_id") -> DataFrame:
    """``key, path, lang, content, is_new`` of each event with a path and content.

    Before the tool ran the event's own content counts; after it the file's as found in ``disk`` (``path, content``), if it
    is there. Line ends become LF. Events without path or content have no file row.
    """
    own = events.select(key, event_path().alias("path"), event_content().alias("__own"), (F.col("hook_event_name") == "PreToolUse").alias("__pre"), (F.col("tool_name") == "Write").alias("is_new"))
    content = F.col("__own")
    if disk is not None:
        own = own.join(disk.select("path", F.col("content").alias("__disk")), "path", "left")
        content = F.when(F.col("__pre"), F.col("__own")).otherwise(F.coalesce("__disk", "__own"))
    rows = own.select(key, "path", language(F.col("path")).alias("lang"), lf(content).alias("content"), "is_new")
    return rows.where(F.col("path").isNotNull() & F.col("content").isNotNull())
