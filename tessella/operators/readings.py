"""From model readings to one controlled record per document, layer and field.

The model's answers are an input relation; nothing here calls a model. Requests
are packed from pages, readings are indexed against the asked fields, mapped to
source pages, controlled, and reconciled within their layer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import blank_to_null, number_text

CHARS_PER_TOKEN = 2.9
CONTEXT_TOKENS, OUTPUT_TOKENS, USABLE = 1_000_000, 32_000, 0.85
OUTPUT_LOW, OUTPUT_HIGH = 20_000, 45_000


def tokens(chars: Column) -> Column:
    """Estimated tokens of a text of so many characters."""
    return F.floor(chars / CHARS_PER_TOKEN).cast("long") + 1


def token_budget(overhead: Column | int = 0) -> Column:
    """Tokens of page text that one request can hold beside its overhead."""
    return F.floor((F.lit(CONTEXT_TOKENS - OUTPUT_TOKENS) - overhead) * USABLE).cast("long")


def pack_pages(pages: DataFrame, keys: Sequence[str], *, size: str = "char_count", budget: Column | None = None, page_limit: Column | None = None) -> DataFrame:
    """Greedy requests per group: ``chunks`` (arrays of pages) and ``oversized`` pages.

    A request closes when the next page would break the budget or the page limit,
    so the state is more than a running sum: a fold over the group's pages, which
    are those of one layer of one document.
    """
    budget = token_budget() if budget is None else budget
    limit = F.lit(None).cast("long") if page_limit is None else page_limit.cast("long")
    item = F.struct(F.col("pdf_page").cast("int").alias("page"), tokens(F.col(size)).alias("t"))
    grouped = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("budget", budget).withColumn("page_limit", limit)
    state = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("open"), F.lit(0).cast("long").alias("used"))

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["open"]) > 0) & ((a["used"] + x["t"] > F.col("budget")) | F.coalesce(F.size(a["open"]) >= F.col("page_limit"), F.lit(False)))
        return F.when(full, F.struct(F.array_append(a["done"], a["open"]).alias("done"), F.array(x["page"]).alias("open"), x["t"].alias("used"))).otherwise(
            F.struct(a["done"].alias("done"), F.array_append(a["open"], x["page"]).alias("open"), (a["used"] + x["t"]).alias("used"))
        )

    chunks = F.aggregate("items", state, step, lambda a: F.when(F.size(a["open"]) > 0, F.array_append(a["done"], a["open"])).otherwise(a["done"]))
    large = F.transform(F.filter("items", lambda x: x["t"] > F.col("budget")), lambda x: x["page"])
    return grouped.select(*keys, chunks.alias("chunks"), large.alias("oversized"))


def excerpts(pages: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text of each request: its pages numbered from 1, blank lines between."""
    placed = chunks.select(*keys, F.posexplode("chunks").alias("chunk_index", "page_map")).select(*keys, "chunk_index", "page_map", F.posexplode("page_map").alias("place", "_page"))
    p = pages.select("document_id", F.col("pdf_page").alias("_page"), "text").withColumn("_page", F.col("_page").cast("int"))
    part = F.struct("place", F.concat(F.lit("[PAGE "), (F.col("place") + 1).cast("string"), F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("t"))
    return placed.join(p, ["document_id", "_page"], "left").groupBy(*keys, "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("excerpt"))


def estimate(pages: DataFrame, keys: Sequence[str], prices: DataFrame, overhead_tokens: int, model_id: str = "standard") -> DataFrame:
    """Pages, requests, tokens and cost bounds of each group under one price profile.

    An unknown profile is an error, not a default.
    """
    packed = pack_pages(pages, keys, budget=token_budget(overhead_tokens))
    size = pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), tokens(F.sum("char_count")).alias("content_tokens"))
    price = prices.where(F.col("model_id") == model_id).agg(F.max("usd_in").alias("usd_in"), F.max("usd_out").alias("usd_out"))
    checked = lambda c: F.coalesce(price.select(c).scalar(), F.raise_error(F.lit(f"unknown model profile {model_id}")).cast("double"))
    out = packed.join(size, list(keys)).withColumn("requests", F.size("chunks").cast("long"))
    out = out.withColumn("input_tokens", F.col("content_tokens") + F.col("requests") * overhead_tokens)
    cost = lambda each: (F.col("input_tokens") * checked("usd_in") + F.col("requests") * each * checked("usd_out")) / 1e6
    return out.select(*keys, "pages", "requests", "input_tokens", cost(OUTPUT_LOW).alias("cost_low"), cost(OUTPUT_HIGH).alias("cost_high"))


def field_overhead(registry: DataFrame) -> int:
    """Tokens that naming the asked fields takes in a request."""
    said = registry.agg(F.sum(F.length("field_name") + F.length("value_kind") + 4)).first()[0] or 0
    return int(said / CHARS_PER_TOKEN) + 1


def within_ceiling(estimates: DataFrame, ceiling: float) -> DataFrame:
    """Per document whether the high bound stays below the ceiling."""
    return estimates.groupBy("document_id").agg(F.sum("cost_low").alias("cost_low"), F.sum("cost_high").alias("cost_high")).withColumn("allowed", F.col("cost_high") <= ceiling)


def index_readings(readings: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked fields with their readings: a field without one is kept, with nulls.

    ``asked`` has (document_id, qualified_layer_id, chunk_index, field_name) and
    its chunk's ``page_map``; readings of other names drop out here and are what
    ``unknown_names`` counts.
    """
    return asked.join(readings, ["document_id", "qualified_layer_id", "chunk_index", "field_name"], "left")


def unknown_names(readings: DataFrame, asked: DataFrame) -> DataFrame:
    keys = ["document_id", "qualified_layer_id", "chunk_index", "field_name"]
    odd = readings.join(asked.select(*keys).distinct(), keys, "left_anti")
    return odd.groupBy("document_id", "qualified_layer_id").agg(F.count(F.lit(1)).alias("n_unknown"), F.slice(F.array_sort(F.collect_set("field_name")), 1, 5).alias("names"))


def to_records(indexed: DataFrame) -> DataFrame:
    """Raw records: text stripped, confidence within 0 to 1, excerpt page mapped.

    A page outside the excerpt is no page, never the nearest one.
    """
    said = F.coalesce("found", F.lit(False))
    clean = lambda c: F.when(said, blank_to_null(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")))
    level = F.col("confidence").cast("string").try_cast("double")
    inside = F.col("page").between(1, F.size("page_map"))
    page = F.when(said & inside, F.get(F.col("page_map"), F.col("page") - 1))
    notes = F.array_compact(
        F.array(
            F.when(F.col("found").isNull(), F.lit("the model gave no answer for this field")),
            F.when(said & F.col("confidence").isNotNull() & level.isNull(), F.lit("confidence is not a number; taken as 0")),
            F.when(said & ~F.coalesce(inside, F.lit(False)), F.concat(F.lit("page "), F.coalesce(F.col("page").cast("string"), F.lit("none")), F.lit(" is outside the excerpt"))),
        )
    )
    return indexed.select(
        "document_id", "run_id", F.col("qualified_layer_id").alias("document_layer"), "field_name", "chunk_index", F.coalesce("reading_index", F.lit(0)).alias("reading_index"),
        clean("raw_value").alias("raw_value"), clean("evidence").alias("evidence"), clean("section").alias("section"), page.alias("pdf_page"),
        F.when(said, F.least(F.greatest(F.coalesce(level, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("confidence"),
        F.when(F.col("found").isNull(), "unresolved").otherwise("not_found").alias("status"),
        F.when(F.col("found").isNull(), "exception").otherwise("unreviewed").alias("review_status"),
        F.lit("llm").alias("extraction_method"), notes.alias("notes"),
    )


def keep_omitted(controlled: DataFrame, records: DataFrame) -> DataFrame:
    """Controlled records with the omitted fields' status put back: unresolved, not absent."""
    keys = ["document_id", "document_layer", "field_name", "chunk_index", "reading_index"]
    omitted = records.where("status = 'unresolved'").select(*keys, F.lit(True).alias("_omitted"))
    out = controlled.join(omitted, keys, "left")
    return out.withColumns({"status": F.when(F.col("_omitted"), "unresolved").otherwise(F.col("status")), "review_status": F.when(F.col("_omitted"), "exception").otherwise(F.col("review_status"))}).drop("_omitted")


def reconcile(records: DataFrame) -> DataFrame:
    """One record per document, layer and field.

    One distinct answer: the most confident reading, noted as corroborated when
    there are several. Several: a conflict without a value that lists each. None:
    the first unresolved reading, else the first not found, else the first.
    """
    keys = ["document_id", "document_layer", "field_name"]
    rest = [c for c in records.columns if c not in keys]
    order = F.struct(F.col("chunk_index").alias("c"), F.col("reading_index").alias("r"))
    value = F.coalesce("value_text", number_text(F.col("value_num")), F.col("value_bool").cast("string"))
    ok = (F.col("status") == "found") & value.isNotNull()
    rank = F.struct(ok.alias("ok"), F.when(ok, F.col("confidence")).alias("conf"), F.when(~ok, F.when(F.col("status") == "unresolved", 2).when(F.col("status") == "not_found", 1).otherwise(0)).alias("s"), (-F.col("chunk_index")).alias("c"), (-F.col("reading_index")).alias("r"))
    item = F.when(ok, F.struct(value.alias("v"), order.alias("o"), F.col("pdf_page").alias("p")))
    met = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("best"), F.array_sort(F.collect_list(item)).alias("said"))
    values = F.array_distinct(F.transform("said", lambda x: x["v"]))
    met = met.withColumn("values", values)
    clash = F.size("values") > 1
    pages = lambda v: F.coalesce(blank_to_null(F.array_join(F.array_compact(F.transform(F.filter("said", lambda x: x["v"] == v), lambda x: x["p"].cast("string"))), ", ")), F.lit("unknown"))
    conflict = F.concat(F.array(F.lit("values differ within the layer; withheld for review")), F.transform("values", lambda v: F.concat(F.lit("reading: "), v, F.lit(" (PDF page "), pages(v), F.lit(")"))))
    several = F.array(F.concat(F.lit("corroborated by "), F.size("said").cast("string"), F.lit(" readings in this layer")))
    none = F.array().cast("array<string>")
    changed = {
        "status": F.when(clash, "conflict").otherwise(F.col("best.status")),
        "review_status": F.when(clash, "exception").otherwise(F.col("best.review_status")),
        "notes": F.when(clash, conflict).otherwise(F.concat(F.coalesce("best.notes", none), F.when(F.size("said") > 1, several).otherwise(none))),
        **{c: F.when(~clash, F.col(f"best.{c}")) for c in ("value_num", "value_text", "value_bool")},
    }
    return met.select(*keys, *[changed.get(c, F.col(f"best.{c}")).alias(c) for c in rest])


def qualify_absences(records: DataFrame, unreadable: DataFrame) -> DataFrame:
    """A note on every absent field of a layer that has unreadable body pages."""
    bad = unreadable.groupBy("document_id", F.col("qualified_id").alias("document_layer")).agg(F.array_sort(F.collect_list("pdf_page")).alias("_bad"))
    note = F.concat(F.lit("absence is not certain: unreadable pages "), F.array_join(F.transform(F.slice("_bad", 1, 8), lambda p: p.cast("string")), ", "))
    out = records.join(bad, ["document_id", "document_layer"], "left")
    return out.withColumn("notes", F.when((F.col("status") == "not_found") & F.col("_bad").isNotNull(), F.array_append(F.coalesce("notes", F.array().cast("array<string>")), note)).otherwise(F.col("notes"))).drop("_bad")


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("document_id", "status").agg(F.count(F.lit(1)).alias("n_fields"))


def token_totals(runs: DataFrame) -> DataFrame:
    """Token sums per document and run; billed input counts cache reads and writes too."""
    out = runs.groupBy("document_id", "run_id").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")])
    return out.withColumn("billed_input_tokens", F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens"))
