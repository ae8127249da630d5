"""Timeline of milestones with calculated extension dates, and the hedge horizon.

Input is the result of ``compare``; everything is keyed by document, so any
number of documents is one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella import dims
from tessella.functions.clauses import ISO_DATE, extension, extension_kind, step_days
from tessella.operators.compare import attempted, shown

COLUMNS = ("document_id", "event", "field_name", "timeline_section", "section_rank", "ordinal", "kind", "basis", "resolved_date", "stated_as", "derivation", "layer", "page", "section_ref", "evidence", "locator_uri", "status", "review_status", "preferred_value")


def _mentioned(compared: DataFrame) -> tuple:
    """Whether a row is an entry, and its reading: the preferred one, else one that was tried."""
    tried = F.coalesce(attempted(F.col("agreement")), F.lit(False)), F.coalesce(attempted(F.col("summary")), F.lit(False))
    reading = F.coalesce("preferred", F.when(tried[0], F.col("agreement")), F.when(tried[1], F.col("summary")))
    return (F.col("classification") != "not_applicable") & (F.col("preferred").isNotNull() | tried[0] | tried[1]), reading


def _stated():
    return F.coalesce(F.when(F.length("_r.raw_value") > 0, F.col("_r.raw_value")), F.col("preferred_value"))


def entries(compared: DataFrame, milestones: DataFrame | None = None) -> DataFrame:
    """Extracted entries: milestones that apply and that some source mentions."""
    milestones = dims.milestones(compared.sparkSession) if milestones is None else milestones
    m = milestones.withColumnRenamed("field_name", "_field")
    said, r = _mentioned(compared)
    rows = compared.where(said).join(m, F.col("field_name") == F.col("_field"))
    rows = rows.withColumns({"_r": r, "preferred_value": shown(F.col("preferred"))})
    iso = F.col("preferred.value_text").rlike(ISO_DATE)
    kind = (
        F.when((F.col("default_kind") == "fixed") & iso, "fixed")
        .when(F.col("default_kind") == "fixed", "relative")
        .when(F.col("field_name") == "extension_conditions", extension_kind(F.col("preferred_value")))
        .otherwise(F.col("default_kind"))
    )
    return rows.select(
        "document_id", "event", "field_name", "timeline_section", "section_rank", "ordinal", kind.alias("kind"), F.lit("extracted").alias("basis"),
        F.when(iso, F.try_to_date("preferred.value_text", "yyyy-MM-dd")).alias("resolved_date"),
        _stated().alias("stated_as"),
        F.lit(None).cast("string").alias("derivation"), F.col("_r.document_layer").alias("layer"), F.col("_r.page").alias("page"), F.col("_r.section").alias("section_ref"),
        F.col("_r.evidence").alias("evidence"), F.col("_r.locator_uri").alias("locator_uri"), F.col("_r.status").alias("status"), F.col("_r.review_status").alias("review_status"), "preferred_value",
    )


def extension_entries(extracted: DataFrame) -> DataFrame:
    """Dates that an extension clause implies, one step after the other."""
    outside = extracted.where((F.col("field_name") == "outside_date") & F.col("resolved_date").isNotNull()).select("document_id", F.col("resolved_date").alias("_from"))
    clause = extracted.where(F.col("field_name") == "extension_conditions").withColumn("_p", extension(F.col("stated_as"))).where("_p is not null")
    steps = clause.join(outside, "document_id").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_p.count"))))
    unit = F.concat(F.col("_p.amount").cast("string"), F.lit(" "), F.col("_p.unit"), F.when(F.col("_p.amount") != 1, "s").otherwise(""))
    told = F.concat(F.date_format("_from", "yyyy-MM-dd"), F.lit(" + "), F.col("_i").cast("string"), F.lit(" x "), unit, F.when(F.col("_p.unit") == "month", " (months counted as 30 days)").otherwise(""))
    event = F.concat(F.lit("Outside date, extension "), F.col("_i").cast("string"), F.lit(" of "), F.col("_p.count").cast("string"))
    changed = {"event": event, "basis": F.lit("calculated"), "resolved_date": F.date_add("_from", F.col("_i") * step_days(F.col("_p"))), "derivation": told}
    return steps.select(*[changed.get(c, F.col(c)).alias(c) for c in COLUMNS])


def build(compared: DataFrame, milestones: DataFrame | None = None) -> DataFrame:
    """All entries, extracted and calculated."""
    extracted = entries(compared, milestones)
    return extracted.unionByName(extension_entries(extracted))


def anchored(timeline: DataFrame) -> DataFrame:
    return timeline.where("resolved_date is not null").orderBy("document_id", "resolved_date", "ordinal", "event")


def unanchored(timeline: DataFrame) -> DataFrame:
    return timeline.where("resolved_date is null").orderBy("document_id", "section_rank", "event")


def calculated(timeline: DataFrame) -> DataFrame:
    return timeline.where("basis = 'calculated'")


def horizon(compared: DataFrame, milestones: DataFrame | None = None) -> DataFrame:
    """One row per document: base, extension and total days, dates and notes.

    One aggregation over the compared fields; an extension clause is read once a
    document, after it.
    """
    milestones = dims.milestones(compared.sparkSession) if milestones is None else milestones
    waits = milestones.where("default_kind = 'conditional'").select(F.col("field_name").alias("_wait")).distinct()
    known = milestones.select(F.col("field_name").alias("_field")).distinct()
    said, r = _mentioned(compared)
    rows = compared.join(F.broadcast(known), F.col("field_name") == F.col("_field"), "left").join(F.broadcast(waits), F.col("field_name") == F.col("_wait"), "left")  # milestones are a short list
    rows = rows.withColumns({"_said": said & F.col("_field").isNotNull(), "_r": r, "preferred_value": shown(F.col("preferred"))})
    iso = F.when(F.col("preferred.value_text").rlike(ISO_DATE), F.try_to_date("preferred.value_text", "yyyy-MM-dd"))
    of = lambda f, v: F.max(F.when(F.col("_said") & (F.col("field_name") == f), v))
    out = rows.groupBy("document_id").agg(
        of("agreement_date", iso).alias("signing_date"),
        of("outside_date", iso).alias("outside_date"),
        of("extension_conditions", extension_kind(F.col("preferred_value"))).alias("extension_kind"),
        of("extension_conditions", _stated()).alias("extension_stated_as"),
        F.count_if(F.col("_wait").isNotNull() & F.col("preferred").isNotNull()).alias("outstanding_conditions"),
    )
    out = out.withColumn("_p", F.when(F.col("outside_date").isNotNull(), extension(F.col("extension_stated_as"))))
    dates = F.transform(F.sequence(F.lit(1), F.col("_p.count")), lambda i: F.date_add("outside_date", i * step_days(F.col("_p"))))
    out = out.withColumn("extension_dates", F.coalesce(F.array_sort(F.when(F.col("_p").isNotNull(), dates)), F.array().cast("array<date>"))).drop("_p")
    out = out.withColumn("final_outside_date", F.array_max("extension_dates"))
    base = F.date_diff("outside_date", "signing_date")
    more = F.date_diff("final_outside_date", "outside_date")
    notes = F.array(
        F.when(base.isNull(), F.lit("no fixed pair of signing and outside date")),
        F.when(F.col("extension_kind").isNotNull() & more.isNull(), F.lit("extension found but not quantified; the window is the unextended one")),
        F.when(more.isNotNull(), F.lit("the extended outside date is calculated from the clause")),
    )
    return out.withColumns({"base_days": base, "extension_days": more, "total_days": base + F.coalesce(more, F.lit(0)), "is_complete": F.col("signing_date").isNotNull() & F.col("outside_date").isNotNull(), "notes": F.array_compact(notes)})


def numbered(timeline: DataFrame) -> DataFrame:
    """Entries with their place in the document's order: dated first, then by section."""
    order = Window.partitionBy("document_id").orderBy(F.col("resolved_date").asc_nulls_last(), "section_rank", "ordinal", "event")
    return timeline.withColumn("place", F.row_number().over(order))
