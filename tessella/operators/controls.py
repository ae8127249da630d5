"""Fail-closed controls on readings, validation, and applicability of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import dims
from tessella.functions.normalize import by_kind
from tessella.functions.text import collapse, evidence, parse_locator


def applies(structure: Column, applies_to: Column) -> Column:
    """Whether a field exists in a structure; an unknown structure has every field."""
    return structure.isNull() | (structure == "unknown") | applies_to.isNull() | F.array_contains(applies_to, structure)


def fields_for(registry: DataFrame, structure: str | None, applicable: bool = True) -> DataFrame:
    """Fields that a structure has, or those that it lacks."""
    good = applies(F.lit(structure).cast("string"), F.col("applies_to"))
    return registry.where(good if applicable else ~good)


def fields_by_category(registry: DataFrame) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "field_name"))), lambda x: x["field_name"])
    return registry.groupBy("category", "category_rank").agg(listed.alias("fields")).orderBy("category_rank")


def not_applicable_rows(structures: DataFrame, registry: DataFrame, run_id: Column) -> DataFrame:
    """A deterministic row for each field that a document's structure lacks."""
    lacks = ~applies(F.col("structure"), F.col("applies_to"))
    return structures.select("document_id", "structure").join(registry, lacks).select(
        "document_id",
        "field_name",
        "category",
        F.lit(None).cast("string").alias("document_layer"),
        F.lit("deterministic").alias("extraction_method"),
        F.lit(1.0).alias("confidence"),
        F.lit("not_applicable").alias("status"),
        F.lit("unreviewed").alias("review_status"),
        run_id.alias("run_id"),
    )


def apply_controls(rows: DataFrame, registry: DataFrame, *, verify: bool = True, compose: bool = True) -> DataFrame:
    """Decide the status of each reading; a control can only demote.

    Order: unknown field, not applicable, empty reading, normalization, evidence,
    confidence. Raw value and quote are always kept. ``rows`` has the raw
    reading, its locator and, joined by the caller, ``page_text``; a page that the
    join did not find fails the check. ``verify=False`` skips the evidence test
    of quotes that do have a page.
    """
    spec = registry.select(F.col("field_name").alias("_field"), "value_kind", "is_critical", "threshold", "enum_values", F.col("category").alias("_category"))
    keep = [c for c in rows.columns if c not in {"value_kind", "is_critical", "threshold", "enum_values", "category", "value_num", "value_text", "value_bool", "normalization_status", "evidence_verified", "notes"}]
    out = rows.select(*keep, F.col("notes").alias("_notes") if "notes" in rows.columns else F.array().cast("array<string>").alias("_notes"))
    out = out.join(spec, F.col("field_name") == F.col("_field"), "left")
    out = out.withColumn("_n", by_kind(F.col("field_name"), F.col("value_kind"), F.col("enum_values"), F.col("raw_value")))
    out = out.withColumn("_e", evidence(F.col("evidence"), parse_locator(F.col("locator_uri"))["anchor"], F.col("page_text"), compose))
    known = F.col("_field").isNotNull()
    passed = F.coalesce(F.col("status") == "not_applicable", F.lit(False))
    empty = F.col("raw_value").isNull() | (collapse(F.col("raw_value")) == "")
    live = known & ~passed & ~empty
    normal = F.col("_n.status") == "ok"
    no_quote = F.col("evidence").isNull()
    no_page = ~no_quote & F.col("pdf_page").isNull()
    failed = ~no_quote & ~no_page & F.lit(verify) & ~F.col("_e.ok")
    evident = ~no_quote & ~no_page & ~failed
    sure = F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False))
    found = live & normal & evident & sure
    held = live & ~found
    low = live & normal & evident & ~sure
    said = [
        F.when(~known, F.concat(F.lit("field is not in the registry: "), F.col("field_name"))),
        F.when(live & F.col("_n.qualifier").isNotNull(), F.concat(F.lit("the source qualifies this figure: "), F.col("_n.qualifier"))),
        F.when(live & ~normal, F.concat(F.lit("normalization "), F.col("_n.status"), F.lit(": "), F.col("_n.reason"))),
        F.when(live & no_quote, F.lit("no evidence quote came with this value")),
        F.when(live & no_page, F.lit("evidence cannot be checked: no source page")),
        F.when(live & failed, F.concat(F.lit("evidence check failed: "), F.col("_e.reason"))),
        F.when(low, F.concat(F.lit("confidence "), F.format_number("confidence", 2), F.lit(" is below "), F.format_number("threshold", 2))),
    ]
    value = lambda c: F.when(found, F.col(f"_n.{c}"))
    return out.withColumns(
        {
            "category": F.col("_category"),
            "is_critical": F.coalesce("is_critical", F.lit(False)),
            "value_num": value("value_num"),
            "value_text": value("value_text"),
            "value_bool": value("value_bool"),
            "normalization_status": F.when(live, F.col("_n.status")),
            "evidence_verified": F.when(live, F.when(no_quote | no_page, F.lit(False)).when(F.lit(verify), F.col("_e.ok"))),
            "confidence": F.when(known & ~passed & empty, 0.0).otherwise(F.col("confidence")),
            "review_status": F.when(~known | held, "exception").otherwise(F.coalesce("review_status", F.lit("unreviewed"))),
            "notes": F.concat("_notes", F.array_compact(F.array(*said))),
            "status": F.when(~known, "unresolved").when(passed, "not_applicable").when(empty, "not_found").when(found, "found").otherwise("unresolved"),
        }
    ).drop("_n", "_e", "_field", "_category", "_notes", "value_kind", "threshold", "enum_values", "page_text")


STATUSES = ("found", "not_found", "not_applicable", "conflict", "unresolved")
REVIEWS = ("unreviewed", "verified", "exception")
METHODS = ("deterministic", "llm", "manual", "hybrid")


def violations(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """``rows`` with the list of what is structurally wrong with each."""
    names = registry.select(F.col("field_name").alias("_field")).distinct()
    blank = lambda c: F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) == 0
    found = F.col("status") == "found"
    value = F.col("value_num").isNull() & F.col("value_text").isNull() & F.col("value_bool").isNull()
    tests = [
        (F.col("_field").isNull(), "unknown field_name"),
        (blank("document_id"), "document_id is missing"),
        (blank("run_id"), "run_id is missing"),
        (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "invalid status"),
        (~F.coalesce(F.col("review_status").isin(*REVIEWS), F.lit(False)), "invalid review_status"),
        (~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence outside 0 to 1"),
        (~F.coalesce(F.col("extraction_method").isin(*METHODS), F.lit(False)), "invalid extraction_method"),
        (found & value, "found without a value"),
        (found & blank("evidence"), "found without evidence"),
        (found & F.col("pdf_page").isNull(), "found without a page"),
    ]
    listed = F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in tests]))
    return rows.join(names, F.col("field_name") == F.col("_field"), "left").withColumn("violations", listed).drop("_field")
