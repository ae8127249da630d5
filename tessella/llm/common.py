"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and the five ASCII controls.
SPACE = r"[\x20\x09-\x0D]+"

_written: list[str] = []


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, as spark.checkpoint.dir names it.

    Only a session on one machine (``local`` masters, as in tests) may leave the
    setting out; on a cluster a machine-local folder would lose rows, so it fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"/tmp/checkpoints/{os.getuid()}"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: a lost executor costs the tasks that it ran, never the
    steps before the written table. ``discard`` deletes a table that no later
    step reads; the rest goes when the session's Python process ends. Tables of a
    few narrow rows are better left uncompressed: a codec's direct buffers for
    each of many small files outweigh them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tessella_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables whose readers have all been written."""
    for table in tables:
        path = getattr(table, "_tessella_path", None)
        if path in _written:
            _delete(table.sparkSession, path)
            _written.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for path in _written:
            _delete(spark, path)
    except Exception:  # the JVM may be gone already; the folder has its own clean-up then
        pass


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """A materialised copy of ``df`` with ``place``, its rows' exact places from 0 on
    in a total order.

    No window runs over all rows: rows are range-sorted, numbered inside each
    range, and the ranges' offsets come from one row per range.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    dealt = df.withColumns(dict(zip(keys, order, strict=True)))
    sort = [F.col(k).asc_nulls_last() for k in keys]
    dealt = materialise(dealt.repartitionByRange(*sort).withColumn("__range", F.spark_partition_id()), "numbered", "none")
    counts = dealt.groupBy("__range").count()
    before = counts.select(F.col("__range").alias("__r"), (F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("__before"))
    inside = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*sort)))
    out = inside.join(before, F.col("__range") == F.col("__r")).withColumn("place", F.col("__before") + F.col("__at") - 1)
    return out.drop("__range", "__r", "__before", "__at", *keys)


class Identities:
    """Ids under which every different text of a table is a document of its own.

    Usually each id has one text and ids stay. Else ``rows`` has ``doc_id`` as
    ``rank * most + place``: the rank of the id, times the largest number of texts
    under one id, and the text's place among its id's; so the order of ids holds
    and nothing overflows. Null ids stay null.
    """

    def __init__(self, base: DataFrame):
        """``base`` has ``doc_id`` (long) and ``text``."""
        h = F.xxhash64(F.coalesce("text", F.lit("")))
        texts = base.where("doc_id is not null").select("doc_id", h.alias("h"))
        kinds = texts.groupBy("doc_id").agg(F.count_distinct("h").alias("n")).where("n > 1")
        self.most = kinds.agg(F.max("n")).first()[0] or 1
        self.rows = base
        if self.most == 1:
            return
        several = texts.join(kinds.select(F.col("doc_id").alias("k_id")), F.col("doc_id") == F.col("k_id"), "left_semi").distinct()
        order = Window.partitionBy("doc_id").orderBy("h")
        self.places = materialise(several.select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), (F.row_number().over(order) - 1).alias("place_")), "id-places", "none")
        ids = numbered(base.where("doc_id is not null").select("doc_id").distinct(), F.col("doc_id"))
        self.ids = materialise(ids.select(F.col("doc_id").alias("i_id"), F.col("place").alias("rank_")), "id-ranks", "none")
        placed = self.placed(base).join(self.ids, F.col("doc_id") == F.col("i_id"), "left")
        self.rows = placed.select((F.col("rank_") * self.most + F.col("__tessella_place")).alias("doc_id"), "text")

    def placed(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``df`` with ``__tessella_place``, the place of a row's text among its id's texts."""
        place = F.lit(0).cast("long")
        if self.most > 1:
            h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
            named = self.places.select(*[F.col(c).alias(f"__tessella_{c}") for c in self.places.columns])
            df = df.join(named, (F.col(doc_id) == F.col("__tessella_r_id")) & (h == F.col("__tessella_r_h")), "left")
            place = F.coalesce("__tessella_place_", place).cast("long")
        return df.withColumn("__tessella_place", place).drop("__tessella_r_id", "__tessella_r_h", "__tessella_place_")

    def back(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with the table's own ids in the given columns."""
        if self.most == 1:
            return df
        for c in columns:
            df = df.join(self.ids, F.expr(f"`{c}` div {self.most}") == F.col("rank_"), "left").withColumn(c, F.col("i_id")).drop("i_id", "rank_")
        return df


def bounded_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Hand texts to Python in smaller batches than Spark's default, unless the
    session has chosen a size: the default's 10,000 long texts are too much for
    several Python workers beside one executor's heap. Queries and pipeline
    stages call this; the operators leave a caller's session as it is."""
    for key, default, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", None, "33554432")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def portable(module_name: str) -> None:
    """Let functions of a module travel to executors that lack the repository."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module_name])
