"""Classification of the transaction structure by weighted signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella import dims


def evidence(pages: DataFrame, signatures: Sequence[tuple[str, str, int, str]] = dims.STRUCTURE_SIGNATURES) -> DataFrame:
    """Each signature once per document, at its first page.

    The signatures are a short list, so a page tests them all in one projection
    and only hits leave it; first pages are found by partial aggregation.
    """
    hits = [
        F.when(
            F.col("text").rlike("(?iU)" + p),
            F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("structure"), F.lit(n).alias("note"), F.lit(w).alias("weight"), F.substring(F.trim(F.regexp_replace(F.regexp_extract("text", "(?iU)" + p, 0), r"(?U)\s+", " ")), 1, 120).alias("matched_text")),
        )
        for i, (s, p, w, n) in enumerate(signatures)
    ]
    found = pages.select("document_id", "pdf_page", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("document_id", "pdf_page", "h.*")
    first = F.min(F.struct("pdf_page", "ordinal", "matched_text")).alias("at")
    return found.groupBy("document_id", "structure", "note", "weight").agg(first).select("document_id", "structure", "note", "weight", "at.pdf_page", "at.ordinal", "at.matched_text")


def scores(found: DataFrame) -> DataFrame:
    """Structures of a document by score; ties go to the one seen first."""
    summed = found.groupBy("document_id", "structure").agg(F.sum("weight").cast("long").alias("score"), F.min(F.struct("pdf_page", "ordinal")).alias("seen"))
    w = Window.partitionBy("document_id")
    order = w.orderBy(F.desc("score"), "seen")
    return summed.select("document_id", "structure", "score", F.row_number().over(order).alias("rank"), F.lead("score").over(order).alias("next_score"), F.sum("score").over(w).alias("total"), F.max("score").over(w).alias("top"))


def classify(documents: DataFrame, scored: DataFrame, min_score: int = dims.MIN_SCORE, min_ratio: float = dims.MIN_RATIO) -> DataFrame:
    """One row per document: structure, confidence, secondaries, review status and note."""
    top = scored.where("rank = 1").withColumn("runner", F.coalesce("next_score", F.lit(0)))
    others = scored.where((F.col("rank") > 1) & ((F.col("score") >= min_score) | (F.col("score") >= F.col("top") / min_ratio)))
    second = others.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "structure"))), lambda x: x["structure"]).alias("secondary"))
    rows = documents.select("document_id").distinct().join(top, "document_id", "left").join(second, "document_id", "left")
    weak = F.col("score") < min_score
    mixed = (F.col("runner") > 0) & (F.col("score") < F.col("runner") * min_ratio)
    none = F.array().cast("array<string>")
    return rows.select(
        "document_id",
        F.when(F.col("score").isNull() | weak, "unknown").otherwise(F.col("structure")).alias("structure"),
        F.when(F.col("score").isNull(), 0.0).when(weak, F.bround(F.col("score") / min_score, 2)).otherwise(F.bround(F.col("score") / F.col("total"), 2)).alias("confidence"),
        F.when(~weak & mixed, F.coalesce("secondary", none)).otherwise(none).alias("secondary_structures"),
        F.when(F.col("score").isNull() | weak | mixed, "exception").otherwise("unreviewed").alias("review_status"),
        F.when(F.col("score").isNull(), "no structure language").when(weak, "best score is below the threshold").when(mixed, "hybrid: no clear lead").alias("note"),
    )
