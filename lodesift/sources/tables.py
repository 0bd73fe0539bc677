"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``<directory>/<name>.parquet``, a file or a folder of files; columns are pruned by the plan."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
