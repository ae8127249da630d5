"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction,
mixing and packing, each over all that the stage before kept.

Edge cases: a null or empty text has no words and fails the quality rules; a very
long text passes through every stage whole. Rows that are equal in id and text
become one row, rows of one id with different texts are different documents; of
linked documents the smallest id stays, rows without an id always. A null source
is a source of its own. Extra columns, whatever their names, pass to the last
stage, which returns pieces. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import jaccard_join, mixing, quality_rules, queries, secrets
from tessella.llm.common import bounded_batches, discard, materialise
from tessella.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject."""
    bounded_batches(spark)
    return quality_rules.keep(docs, queries.trusted(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by 5-word shingles at 0.8 or more; op3's own figures are 4 and 0.85."""
    bounded_batches(spark)
    return jaccard_join.keep(docs, words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret that the scan reports."""
    bounded_batches(spark)
    return secrets.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their targets."""
    bounded_batches(spark)
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, as query op10 returns them."""
    bounded_batches(spark)
    return queries.packed(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixing", mix), ("packing", pack)]

#: SQL cannot say the hashed ratio, the rounding or the tokenizer; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
