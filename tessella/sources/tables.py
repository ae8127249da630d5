"""Table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
