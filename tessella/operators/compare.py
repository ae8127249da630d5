"""Two-source comparison of every field, in seven classes.

Input rows follow ``extracted_fields``. Both sources of a field meet by one
conditional aggregation per (document, field): one shuffle and no join. The
registry is a join on the field name, for category, criticality and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import dims
from tessella.functions.normalize import embedded_amounts
from tessella.functions.text import blank_to_null, collapse, fold_case, number_text

NARRATIVE = 80
TOLERANCE = 1e-9
SUMMARY, AGREEMENT = "filing-summary", "agreement"
ATTEMPTED = ("found", "conflict", "unresolved")
VALUE = ("value_num", "value_text", "value_bool")


def base_layer(layer: Column, letters: bool = False) -> Column:
    """Layer kind without its exhibit or ordinal suffix; ``letters`` strips letter exhibits too."""
    return F.regexp_replace(blank_to_null(layer), r"-(?:ex[\d.]+|ex[a-z]|\d+)$" if letters else r"-(?:ex[\d.]+|\d+)$", "")


def has_value(r: Column) -> Column:
    return r["value_num"].isNotNull() | r["value_text"].isNotNull() | r["value_bool"].isNotNull()


def shown(r: Column) -> Column:
    """A typed value as text."""
    return F.coalesce(r["value_text"], number_text(r["value_num"]), r["value_bool"].cast("string"))


def identical(a: Column, b: Column) -> Column:
    """Same value written alike: booleans, numbers within a relative tolerance, else collapsed text."""
    flags = a["value_bool"].isNotNull() | b["value_bool"].isNotNull()
    numbers = a["value_num"].isNotNull() & b["value_num"].isNotNull()
    near = F.abs(a["value_num"] - b["value_num"]) <= TOLERANCE * F.greatest(F.abs(a["value_num"]), F.abs(b["value_num"]))
    return F.when(flags, F.coalesce(a["value_bool"] == b["value_bool"], F.lit(False))).when(numbers, near).otherwise(collapse(shown(a)) == collapse(shown(b)))


def equivalent(a: Column, b: Column) -> Column:
    """Same value but for case and spacing."""
    texts = a["value_text"].isNotNull() & b["value_text"].isNotNull()
    return F.when(texts, fold_case(collapse(a["value_text"])) == fold_case(collapse(b["value_text"]))).otherwise(identical(a, b))


def contains_either(a: Column, b: Column) -> Column:
    x, y = fold_case(collapse(a)), fold_case(collapse(b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def text_class(a: Column, b: Column, whole_words: bool = False) -> Column:
    """(class, reason) of two texts: amounts decide first, then containment, then length."""
    x, y = F.coalesce(shown(a), F.lit("")), F.coalesce(shown(b), F.lit(""))
    p, q = embedded_amounts(x, whole_words), embedded_amounts(y, whole_words)
    both = (F.size(p) > 0) & (F.size(q) > 0)
    told = lambda v: F.array_join(F.transform(v, number_text), ", ")
    out = lambda c, r: F.struct(F.lit(c).alias("classification"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return (
        F.when(both & F.arrays_overlap(p, q), out("normalized_match", F.concat(F.lit("other words, same amounts: "), told(F.array_intersect(p, q)))))
        .when(both, out("conflict", F.concat(F.lit("amounts differ: "), told(p), F.lit(" against "), told(q))))
        .when(contains_either(x, y), out("normalized_match", "one is a shorter form of the other"))
        .when(F.greatest(F.length(x), F.length(y)) > NARRATIVE, out("normalized_match", "prose without differing amounts; worded differently"))
        .otherwise(out("conflict", F.concat(F.lit("different values: "), x, F.lit(" against "), y)))
    )


def attempted(r: Column) -> Column:
    return F.coalesce(r["status"].isin(*ATTEMPTED), F.lit(False)) | (F.length(F.coalesce(r["raw_value"], F.lit(""))) > 0)


def _one_sided(there: str, other: str, missing: Column) -> Column:
    said = F.length(F.coalesce(missing["raw_value"], F.lit(""))) > 0
    return (
        F.when(~attempted(missing), F.lit(f"only the {there} has a value; the {other} is silent"))
        .when(said, F.concat(F.lit(f"only the {there} has a value; the {other} said '"), missing["raw_value"], F.lit("', which a control withheld")))
        .otherwise(F.concat(F.lit(f"only the {there} has a value; the {other}'s reading was withheld ("), missing["status"], F.lit(")")))
    )


def classify(s: Column, a: Column, kind: Column, inapplicable: Column, whole_words: bool = False) -> Column:
    """(class, reason) of a field from its two readings; either may be null."""
    ok = lambda r: F.coalesce((r["status"] == "found") & has_value(r), F.lit(False))
    out = lambda c, r: F.struct(F.lit(c).alias("classification"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    raw_same = collapse(s["raw_value"]).eqNullSafe(collapse(a["raw_value"]))
    both = (
        F.when(s["currency"] != a["currency"], out("conflict", F.concat(F.lit("different currencies: "), s["currency"], F.lit(" and "), a["currency"])))
        .when(identical(s, a) & raw_same, out("match", "same value, same words"))
        .when(identical(s, a), out("normalized_match", F.concat(F.lit("same value, written differently: "), F.coalesce(s["raw_value"], F.lit("-")), F.lit(" and "), F.coalesce(a["raw_value"], F.lit("-")))))
        .when(equivalent(s, a), out("normalized_match", "same value but for case or spacing"))
        .when(kind == "text", text_class(s, a, whole_words))
        .otherwise(out("conflict", F.concat(F.lit("the sources disagree: "), shown(s), F.lit(" against "), shown(a))))
    )
    withheld = lambda r: F.coalesce(r["status"].isin("conflict", "unresolved"), F.lit(False)) | (F.length(F.coalesce(r["raw_value"], F.lit(""))) > 0)
    return (
        F.when(inapplicable, out("not_applicable", "does not apply to this structure"))
        .when(ok(s) & ok(a), both)
        .when(ok(s), out("summary_only", _one_sided("summary", "agreement", a)))
        .when(ok(a), out("agreement_only", _one_sided("agreement", "summary", s)))
        .when(withheld(s) | withheld(a), out("unresolved", "read but withheld by a control"))
        .otherwise(out("unresolved", "neither source reports it"))
    )


READING = ("document_layer", *VALUE, "currency", "raw_value", "page", "section", "evidence", "locator_uri", "confidence", "status", "review_status")


def readings(rows: DataFrame, letters: bool = False) -> DataFrame:
    """Rows as readings: printed page before PDF page, and defaults for what is null.

    ``scan_order`` breaks ties; without such a column rows rank by their layer.
    """
    out = rows.withColumns(
        {
            "base": base_layer(F.col("document_layer"), letters),
            "page": F.coalesce(blank_to_null(F.col("printed_page")), F.col("pdf_page").cast("string")),
            "status": F.coalesce("status", F.lit("not_found")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
        }
    )
    order = F.col("scan_order").cast("long") if "scan_order" in rows.columns else F.lit(0).cast("long")
    answerable = (F.col("status") == "found") & (F.col("value_num").isNotNull() | F.col("value_text").isNotNull() | F.col("value_bool").isNotNull())
    rank = F.struct(answerable.alias("ok"), F.col("confidence").alias("c"), (-order).alias("o"), F.col("document_layer").alias("l"))
    return out.withColumn("_rank", rank).withColumn("_reading", F.struct(*READING))


def best_readings(rows: DataFrame, letters: bool = False) -> DataFrame:
    """The best reading of each document, field and layer kind: answerable first,
    then the most confident, then the first."""
    r = readings(rows, letters)
    return r.groupBy("document_id", "field_name", "base").agg(F.max_by("_reading", "_rank").alias("reading"))


def compare(rows: DataFrame, registry: DataFrame | None = None, *, summary: str = SUMMARY, agreement: str = AGREEMENT, run_id: str | None = None, letters: bool = False, whole_words: bool = False) -> DataFrame:
    """One row per document and field with class, reason and the preferred reading.

    The agreement governs wherever it has a value. ``run_id`` restricts the rows
    to one run; ``letters`` and ``whole_words`` choose the stricter readings of
    layer names and amount scales.
    """
    registry = dims.field_registry(rows.sparkSession) if registry is None else registry
    rows = rows if run_id is None else rows.where(F.col("run_id") == run_id)
    r = readings(rows, letters)
    side = lambda name: F.max_by(F.when(F.col("base") == name, F.col("_reading")), F.when(F.col("base") == name, F.col("_rank")))
    met = r.groupBy("document_id", "field_name").agg(side(summary).alias("summary"), side(agreement).alias("agreement"), F.bool_or(F.col("status") == "not_applicable").alias("inapplicable"))
    met = met.where(F.col("summary").isNotNull() | F.col("agreement").isNotNull() | F.col("inapplicable"))
    known = registry.select(F.col("field_name").alias("_field"), "category", "category_rank", "value_kind", "is_critical")
    met = met.join(known, F.col("field_name") == F.col("_field"), "left").drop("_field").withColumn("is_critical", F.coalesce("is_critical", F.lit(False)))
    met = met.withColumn("_c", classify(F.col("summary"), F.col("agreement"), F.col("value_kind"), F.col("inapplicable"), whole_words))
    ok = lambda c: F.coalesce((F.col(c)["status"] == "found") & has_value(F.col(c)), F.lit(False))
    preferred = F.when(F.col("inapplicable"), None).when(ok("agreement"), F.col("agreement")).when(ok("summary"), F.col("summary"))
    met = met.withColumn("preferred", preferred)
    cls = F.col("_c.classification")
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(dims.CLASS_ORDER) for x in (c, i)])
    wants = (cls == "conflict") | ((cls == "unresolved") & (F.coalesce(attempted(F.col("summary")), F.lit(False)) | F.coalesce(attempted(F.col("agreement")), F.lit(False))))
    return met.withColumns({"classification": cls, "reason": F.col("_c.reason"), "class_rank": rank[cls], "needs_review": wants}).drop("_c")


def triage_ranked(compared: DataFrame) -> DataFrame:
    """Add ``place`` in each document: by category, class and name; unknown categories last."""
    order = Window.partitionBy("document_id").orderBy(F.coalesce("category_rank", F.lit(len(dims.CATEGORY_ORDER))), "class_rank", "field_name")
    return compared.withColumn("place", F.row_number().over(order))


def in_triage_order(compared: DataFrame) -> DataFrame:
    return triage_ranked(compared).orderBy("document_id", "place").drop("place")


def class_counts(compared: DataFrame) -> DataFrame:
    """Fields per document and class, in triage order; classes without any are absent."""
    return compared.groupBy("document_id", "classification", "class_rank").agg(F.count(F.lit(1)).alias("n_fields")).orderBy("document_id", "class_rank").drop("class_rank")


def flat(compared: DataFrame) -> DataFrame:
    """Export shape: a column for each part of both readings and of the preferred one."""
    one = lambda side: [F.col(side)[c].alias(f"{side}_{c}") for c in ("raw_value", "page", "section", "evidence", "locator_uri", "confidence", "status")] + [shown(F.col(side)).alias(f"{side}_value")]
    p = F.col("preferred")
    return compared.select(
        "document_id", "field_name", "category", "is_critical", "classification", "reason", "needs_review", *one("summary"), *one("agreement"),
        p["document_layer"].alias("preferred_layer"), shown(p).alias("preferred_value"), p["page"].alias("preferred_page"), p["locator_uri"].alias("preferred_locator"),
    )
