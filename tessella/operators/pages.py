"""Page integrity: readability, duplicates, printed labels and their rollups.

Input is ``pages(document_id, pdf_page, text, has_images)``. ``prepare`` derives
what the other operators share; cache or write its result before branching.
Windows are per document, whose pages number in the hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.labels import parse_label, printed_label
from tessella.functions.text import content_hash

EMPTY_CHARS, SPARSE_CHARS = 10, 100
MIN_RUN = 4
DUPLICATE_FLOOR, DUPLICATE_SHARE = 200, 0.3


def text_layer_status(chars: Column, has_images: Column, empty: int = EMPTY_CHARS, sparse: int = SPARSE_CHARS) -> Column:
    """image_only, blank, sparse or machine_readable."""
    return (
        F.when((chars < empty) & F.coalesce(has_images, F.lit(False)), "image_only")
        .when(chars < empty, "blank")
        .when(chars < sparse, "sparse")
        .otherwise("machine_readable")
    )


def prepare(pages: DataFrame, compose: bool = True) -> DataFrame:
    """Add char_count (of the stripped text), status, content hash and printed label."""
    stripped = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    out = pages.withColumn("char_count", F.length(stripped))
    return out.withColumns(
        {
            "text_layer_status": text_layer_status(F.col("char_count"), F.col("has_images")),
            "content_hash": content_hash(F.col("text"), compose),
            "printed_page": printed_label(F.col("text")),
        }
    )


def _issue(kind, severity, pages: Column, detail: Column) -> list[Column]:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [as_col(kind).alias("kind"), as_col(severity).alias("severity"), pages.alias("pdf_pages"), detail.alias("detail")]


def upper_median(pages: DataFrame) -> DataFrame:
    """Per document the middle page size, the upper one of two (pages with text only)."""
    w = Window.partitionBy("document_id")
    ranked = pages.where(F.col("char_count") >= EMPTY_CHARS).select(
        "document_id", "char_count", F.row_number().over(w.orderBy("char_count")).alias("rank"), F.count(F.lit(1)).over(w).alias("n")
    )
    return ranked.where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select("document_id", F.col("char_count").alias("median_chars"))


def duplicate_issues(pages: DataFrame) -> DataFrame:
    """Groups of pages with equal canonical text; an error where the page is large
    for its document, else a note."""
    groups = (
        pages.where(F.col("char_count") >= EMPTY_CHARS)
        .groupBy("document_id", "content_hash")
        .agg(F.sort_array(F.collect_list("pdf_page")).alias("pages"), F.min_by("char_count", "pdf_page").alias("chars"))
        .where(F.size("pages") > 1)
    )
    floor = F.greatest(F.lit(DUPLICATE_FLOOR), F.floor(F.coalesce("median_chars", F.lit(0)) * DUPLICATE_SHARE))
    detail = F.concat(F.lit("equal text on PDF pages "), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit(" ("), F.col("chars").cast("string"), F.lit(" characters)"))
    return groups.join(upper_median(pages), "document_id", "left").select("document_id", *_issue("duplicate_page", F.when(F.col("chars") >= floor, "error").otherwise("info"), F.col("pages"), detail))


def readability(pages: DataFrame) -> DataFrame:
    """Per document the sorted pages of each status."""
    listed = lambda status: F.array_sort(F.collect_list(F.when(F.col("text_layer_status") == status, F.col("pdf_page"))))
    return pages.groupBy("document_id").agg(listed("image_only").alias("unreadable"), listed("blank").alias("blank"), listed("sparse").alias("sparse"))


def readability_issues(pages: DataFrame) -> DataFrame:
    r = readability(pages)
    parts = []
    for column, kind, severity, said in (("unreadable", "unreadable_page", "error", "pages are images without text: "), ("blank", "blank_page", "info", "pages hold no text: "), ("sparse", "unreadable_page", "warning", "pages hold little text: ")):
        detail = F.concat(F.lit(said), F.array_join(F.transform(column, lambda p: p.cast("string")), ", "))
        parts.append(r.where(F.size(column) > 0).select("document_id", *_issue(kind, severity, F.col(column), detail)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def reconcile_labels(pages: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Add ``series, ordinal, label_offset`` and ``label_source`` (reconciled, rejected, absent).

    A label is trusted when pages next to each other agree on series and offset
    in a run long enough, or when that many pages of the document agree.
    """
    parsed = pages.withColumn("_label", parse_label(F.col("printed_page")))
    out = parsed.withColumns({"series": F.col("_label.series"), "ordinal": F.col("_label.ordinal")}).drop("_label")
    out = out.withColumn("label_offset", F.col("pdf_page") - F.col("ordinal"))
    key = Window.partitionBy("document_id", "series", "label_offset")
    out = out.withColumn("_island", F.col("pdf_page") - F.row_number().over(key.orderBy("pdf_page")))
    run = F.count(F.lit(1)).over(Window.partitionBy("document_id", "series", "label_offset", "_island"))
    trusted = F.col("ordinal").isNotNull() & ((run >= min_run) | (F.count(F.lit(1)).over(key) >= min_run))
    source = F.when(F.col("printed_page").isNull(), "absent").when(trusted, "reconciled").otherwise("rejected")
    return out.withColumn("label_source", source).drop("_island")


def label_issues(reconciled: DataFrame) -> DataFrame:
    """Rejected labels of a document, and gaps inside trusted runs."""
    bad = reconciled.where("label_source = 'rejected'").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pdf_page", "printed_page"))).alias("b"))
    said = F.concat(F.lit("labels outside any consistent run: "), F.array_join(F.transform("b", lambda x: F.concat(F.lit("PDF "), x["pdf_page"].cast("string"), F.lit(" says '"), x["printed_page"], F.lit("'"))), ", "))
    rejected = bad.select("document_id", *_issue("label_anomaly", "warning", F.transform("b", lambda x: x["pdf_page"]), said))
    w = Window.partitionBy("document_id", "series", "label_offset").orderBy("pdf_page")
    steps = reconciled.where("label_source = 'reconciled'").withColumns({"_page": F.lag("pdf_page").over(w), "_label": F.lag("printed_page").over(w)})
    gaps = steps.where(F.col("pdf_page") - F.col("_page") > 1)
    missing = F.sequence(F.col("_page") + 1, F.col("pdf_page") - 1)
    told = F.concat(F.lit("labels go from "), F.col("_label"), F.lit(" to "), F.col("printed_page"), F.lit(" over PDF pages "), F.array_join(F.transform(missing, lambda p: p.cast("string")), ", "))
    found = gaps.select("document_id", *_issue("missing_page", F.when(F.col("pdf_page") - F.col("_page") == 2, "info").otherwise("warning"), missing, told))
    return rejected.unionByName(found)


def integrity_issues(reconciled: DataFrame) -> DataFrame:
    """All issues: duplicates, readability and labels, in that order."""
    parts = [duplicate_issues(reconciled), readability_issues(reconciled), label_issues(reconciled)]
    out = parts[0].withColumn("issue_order", F.lit(0))
    for i, more in enumerate(parts[1:], 1):
        out = out.unionByName(more.withColumn("issue_order", F.lit(i)))
    return out


def inventory(pages: DataFrame) -> DataFrame:
    """Per document: pages, characters, OCR need and whether its text can be trusted."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    rolled = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum("char_count").alias("total_chars"),
        some(F.col("text_layer_status") == "image_only").alias("requires_ocr"),
        some((F.col("text_layer_status") == "sparse") & F.col("has_images")).alias("has_degraded_text"),
    )
    return rolled.withColumn("is_machine_readable", (F.col("total_chars") > 0) & ~F.col("requires_ocr") & ~F.col("has_degraded_text"))


def ingestion_status(reconciled: DataFrame) -> DataFrame:
    """The inventory with the ladder ocr_required, review_required, ingested_with_warnings, ingested."""
    worst = integrity_issues(reconciled).groupBy("document_id").agg(F.bool_or(F.col("severity") == "error").alias("has_errors"), F.bool_or(F.col("severity") == "warning").alias("has_warnings"))
    out = inventory(reconciled).join(worst, "document_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_errors", "has_warnings")})
    status = F.when(F.col("requires_ocr"), "ocr_required").when(F.col("has_errors"), "review_required").when(F.col("has_warnings"), "ingested_with_warnings").otherwise("ingested")
    return out.withColumn("ingestion_status", status)
