"""Review queue, conflicts between layers, and the overlay of human corrections.

Corrections are an append-only relation; the current view of a field is its row
with the latest accepted correction laid over it. Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.normalize import by_kind, currency
from tessella.functions.text import anchor, blank_to_null, collapse, evidence, locator_uri
from tessella.operators.compare import base_layer

KEY = ("document_id", "field_name", "document_layer", "run_id")


def queue(rows: DataFrame) -> DataFrame:
    """Rows in exception: critical first, then conflicts, then unresolved."""
    status = F.when(F.col("status") == "conflict", 0).when(F.col("status") == "unresolved", 1).otherwise(2)
    return rows.where("review_status = 'exception'").orderBy("document_id", F.desc("is_critical"), status, "field_name")


def conflict_rows(rows: DataFrame, compared: DataFrame) -> DataFrame:
    """Both layers' rows of each field in conflict, without rows already verified;
    ``conflict_with`` is the other side."""
    clash = compared.where("classification = 'conflict'")
    shape = lambda mine, other: clash.select("document_id", "field_name", F.col(f"{mine}.document_layer").alias("document_layer"), F.col(other).alias("conflict_with"))
    sides = shape("summary", "agreement").unionByName(shape("agreement", "summary"))
    return rows.join(sides, ["document_id", "field_name", "document_layer"]).where(F.coalesce("review_status", F.lit("unreviewed")) != "verified").withColumn("review_reason", F.lit("layer_conflict"))


def items(rows: DataFrame, compared: DataFrame) -> DataFrame:
    """Exceptions and conflicts, each row once; a conflict's reason wins."""
    conflicts = conflict_rows(rows, compared)
    odd = rows.where("review_status = 'exception'").withColumn("conflict_with", F.lit(None).cast(conflicts.schema["conflict_with"].dataType)).withColumn("review_reason", F.lit("control_exception"))
    every = odd.unionByName(conflicts.select(*odd.columns))
    best = Window.partitionBy(*KEY).orderBy(F.desc(F.col("review_reason") == "layer_conflict"))
    once = every.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return once.orderBy("document_id", F.desc("is_critical"), F.desc(F.col("review_reason") == "layer_conflict"), "field_name", "document_layer")


def judge_corrections(corrections: DataFrame, rows: DataFrame, registry: DataFrame, pages: DataFrame, compose: bool = True) -> DataFrame:
    """Corrections with their outcome: ``accepted`` and either a refusal or the new row.

    Refused: unknown row, unknown field, blank value, a value that does not
    normalize. A quote that its page lacks is accepted and disclosed. Without a
    printed label of its own a correction takes the label of its page.
    """
    now = rows.select(*[F.col(c).alias(f"_k{c}") for c in KEY], F.col("raw_value").alias("_old_raw"), F.col("pdf_page").alias("_old_page"), F.col("printed_page").alias("_old_label"), F.col("section").alias("_old_section"), F.col("evidence").alias("_old_evidence"))
    on = F.col("document_id") == F.col("_kdocument_id")
    for c in KEY[1:]:
        on &= F.col(c).eqNullSafe(F.col(f"_k{c}"))
    spec = registry.select(F.col("field_name").alias("_field"), "value_kind", "enum_values")
    p = pages.select(F.col("document_id").alias("_pdoc"), F.col("pdf_page").alias("_ppage"), F.col("text").alias("_text"), F.col("printed_page").alias("_plabel"))
    out = corrections.join(now, on, "left").join(spec, F.col("field_name") == F.col("_field"), "left")
    out = out.withColumn("_page", F.coalesce("pdf_page", "_old_page")).join(p, (F.col("document_id") == F.col("_pdoc")) & (F.col("_page") == F.col("_ppage")), "left")
    out = out.withColumn("_n", by_kind(F.col("field_name"), F.col("value_kind"), F.col("enum_values"), F.col("raw_value")))
    quote = F.coalesce(blank_to_null(F.col("evidence")), F.col("_old_evidence"))
    out = out.withColumn("_quote", quote).withColumn("_e", evidence(quote, anchor(quote, compose), F.col("_text"), compose))
    blank = F.col("raw_value").isNull() | (collapse(F.col("raw_value")) == "")
    refusal = (
        F.when(F.col("_kdocument_id").isNull(), "no such row")
        .when(F.col("_field").isNull(), "no such field")
        .when(blank, "blank value")
        .when(F.col("_n.status") != "ok", F.concat(F.lit("value does not normalize: "), F.col("_n.reason")))
    )
    moved = F.col("pdf_page").isNotNull() & ~F.col("pdf_page").eqNullSafe(F.col("_old_page"))
    label = F.coalesce(blank_to_null(F.col("printed_page")), F.when(moved, F.col("_plabel")).otherwise(F.coalesce("_old_label", "_plabel")))
    had = F.length(F.coalesce("_old_raw", F.lit(""))) > 0
    notes = F.array_compact(
        F.array(
            F.when(F.length(F.coalesce("reviewer_note", F.lit(""))) > 0, F.concat(F.lit("reviewer: "), F.col("reviewer_note"))),
            F.when(had, F.concat(F.lit("replaces the reading: "), F.col("_old_raw"))),
            F.when(F.col("_quote").isNotNull() & ~F.col("_e.ok"), F.lit("the quote was not found on the cited page")),
        )
    )
    money = F.col("value_kind") == "money"
    return out.select(
        *KEY, "edit_seq", refusal.isNull().alias("accepted"), refusal.alias("refusal"), "raw_value",
        F.col("_n.value_num").alias("value_num"), F.col("_n.value_text").alias("value_text"), F.col("_n.value_bool").alias("value_bool"),
        F.when(money, currency(F.col("raw_value"))["value_text"]).alias("currency"), F.col("_page").alias("pdf_page"), label.alias("printed_page"),
        F.coalesce(blank_to_null(F.col("section")), F.col("_old_section")).alias("section"), F.col("_quote").alias("evidence"),
        F.when(F.col("_page").isNotNull(), locator_uri(F.col("document_id"), F.coalesce("document_layer", F.lit("unknown")), F.col("_page"), label, anchor(F.col("_quote"), compose))).alias("locator_uri"),
        F.when(F.col("_quote").isNotNull(), F.col("_e.ok")).alias("evidence_verified"),
        F.when(had, "hybrid").otherwise("manual").alias("extraction_method"), notes.alias("correction_notes"),
    )


TAKEN = ("raw_value", "value_num", "value_text", "value_bool", "pdf_page", "printed_page", "section", "evidence", "locator_uri", "evidence_verified", "extraction_method")


def overlay(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Current rows: the latest accepted correction replaces value, place and method,
    with full confidence and status found and verified."""
    last = judged.where("accepted").groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in judged.columns if c not in KEY]), "edit_seq").alias("c"))
    last = last.select(*[F.col(k).alias(f"_k{k}") for k in KEY], "c")
    on = F.col("document_id") == F.col("_kdocument_id")
    for c in KEY[1:]:
        on &= F.col(c).eqNullSafe(F.col(f"_k{c}"))
    out = rows.join(last, on, "left")
    has = F.col("c").isNotNull()
    changed = {c: F.when(has, F.col(f"c.{c}")).otherwise(F.col(c)) for c in TAKEN if c in rows.columns}
    changed |= {
        "currency": F.when(has, F.coalesce("c.currency", "currency")).otherwise(F.col("currency")),
        "confidence": F.when(has, 1.0).otherwise(F.col("confidence")),
        "status": F.when(has, "found").otherwise(F.col("status")),
        "review_status": F.when(has, "verified").otherwise(F.col("review_status")),
        "normalization_status": F.when(has, "ok").otherwise(F.col("normalization_status")),
        "notes": F.when(has, F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.col("c.correction_notes"))).otherwise(F.col("notes")),
    }
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns])


def with_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with the latest review decision (key, review_status, note, edit_seq) of a known kind."""
    good = decisions.where(F.col("review_status").isin("unreviewed", "verified", "exception"))
    last = good.groupBy(*KEY).agg(F.max_by(F.struct("review_status", "note"), "edit_seq").alias("d")).select(*[F.col(k).alias(f"_k{k}") for k in KEY], "d")
    on = F.col("document_id") == F.col("_kdocument_id")
    for c in KEY[1:]:
        on &= F.col(c).eqNullSafe(F.col(f"_k{c}"))
    said = F.when(F.length("d.note") > 0, F.array(F.concat(F.lit("review: "), F.col("d.note")))).otherwise(F.array().cast("array<string>"))
    changed = {"review_status": F.coalesce("d.review_status", "review_status"), "notes": F.when(F.col("d").isNotNull(), F.concat(F.coalesce("notes", F.array().cast("array<string>")), said)).otherwise(F.col("notes"))}
    return rows.join(last, on, "left").select(*[changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns])


def bases(rows: DataFrame) -> DataFrame:
    """Rows with the kind of their layer."""
    return rows.withColumn("base", base_layer(F.col("document_layer")))
