"""Filings as they arrive: a file stream that passes each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import document_id


def arriving(spark: SparkSession, path: str, *, horizon: str = "30 days", files_per_trigger: int = 100) -> DataFrame:
    """New files under a folder, one row per distinct checksum.

    State is bounded by the horizon on the files' modification times: a copy
    that comes later than that passes again, and the store's checksum test
    (``Store.unseen``) is what keeps it out.
    """
    raw = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    sum_ = F.sha2("content", 256)
    rows = raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), sum_.alias("checksum"), document_id(sum_).alias("document_id"), F.col("modificationTime").alias("modified_at"), "content")
    return rows.withWatermark("modified_at", horizon).dropDuplicatesWithinWatermark(["checksum"])
