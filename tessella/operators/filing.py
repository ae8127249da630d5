"""The whole way of a filing: ingest, extract, and what is derived from it.

Each function returns named DataFrames, lazy and keyed by document, for any
number of documents at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import dims, schemas
from tessella.operators import controls, layers, pages, readings, structure

INGESTION_VERSION = SCHEMA_VERSION = "1.0.0"


def ingest(raw_pages: DataFrame, files: DataFrame, run_id: str, *, signatures=dims.STRUCTURE_SIGNATURES, instruments=dims.INSTRUMENTS, regions=dims.REGIONS, compose: bool = True, persist: bool = True) -> dict[str, DataFrame]:
    """Integrity, layers, regions, structure and the document record.

    ``raw_pages`` has document_id, pdf_page, text and has_images. Every branch reads
    the prepared pages, so they are persisted unless that is switched off. ``files`` has document_id,
    checksum, filename and, if known, source_url and filing_date.
    """
    prepared = pages.reconcile_labels(pages.prepare(raw_pages, compose))
    prepared = prepared.persist() if persist else prepared
    found_layers = layers.segment_layers(prepared, layers.boundaries(prepared, instruments))
    found_regions = layers.segment_regions(prepared, found_layers, regions)
    evidence = structure.evidence(layers.pages_to_scan(prepared, found_layers, found_regions), signatures)
    classes = structure.classify(prepared, structure.scores(evidence))
    status = pages.ingestion_status(prepared)
    optional = {"source_url": "string", "filing_date": "date"}
    given = files.select("document_id", "checksum", "filename", *[(F.col(c) if c in files.columns else F.lit(None).cast(k)).alias(c) for c, k in optional.items()])
    documents = given.join(status, "document_id").join(classes.select("document_id", F.col("structure").alias("transaction_structure"), F.col("confidence").alias("structure_confidence")), "document_id", "left")
    documents = documents.withColumns({"ingestion_version": F.lit(INGESTION_VERSION), "schema_version": F.lit(SCHEMA_VERSION), "run_id": F.lit(run_id), "ingested_at": F.current_timestamp()})
    trusted = F.when(F.col("label_source") == "reconciled", F.col("printed_page"))
    kept = classes.select("document_id", F.col("structure").alias("_s"), "secondary_structures")
    cited = evidence.join(kept, "document_id").where((F.col("structure") == F.col("_s")) | F.array_contains("secondary_structures", F.col("structure")) | ((F.col("_s") == "unknown"))).drop("_s", "secondary_structures")
    return {
        "documents": documents,
        "document_pages": prepared.select("document_id", "pdf_page", trusted.alias("printed_page"), F.col("label_source").alias("printed_page_source"), "char_count", "text_layer_status", "content_hash", "has_images", "text"),
        "document_layers": found_layers,
        "document_regions": found_regions,
        "integrity_issues": pages.integrity_issues(prepared),
        "structure_evidence": cited,
        "structures": classes,
        "warnings": layers.warnings(found_layers, classes),
        "reconciled": prepared,
    }


def _body(ingested: dict[str, DataFrame], layer_ids: Sequence[str]) -> DataFrame:
    """Body pages of the layers in scope."""
    scope = ingested["document_layers"].where(F.col("layer_id").isin(list(layer_ids)))
    pages_ = ingested["reconciled"] if "reconciled" in ingested else ingested["document_pages"]
    return layers.body_pages(pages_.select("document_id", "pdf_page", "char_count", "text_layer_status"), scope, ingested["document_regions"]).where("qualified_id is not null")


def requests(ingested: dict[str, DataFrame], overhead_tokens: int = 0, layer_ids: Sequence[str] = dims.EXTRACTABLE_LAYERS) -> DataFrame:
    """Requests of each layer in scope: chunk_index and page_map over its body pages."""
    keys = ["document_id", "layer_id", "qualified_id"]
    packed = readings.pack_pages(_body(ingested, layer_ids), keys, budget=readings.token_budget(overhead_tokens))
    return packed.select(*keys, F.posexplode("chunks").alias("chunk_index", "page_map"))


def asked(ingested: dict[str, DataFrame], packed: DataFrame, registry: DataFrame, scope: DataFrame) -> DataFrame:
    """One row per request and field that applies to the structure and the layer."""
    fields = registry.join(scope, "category").select("layer_id", "field_name", "applies_to")
    structures = ingested["structures"].select("document_id", "structure")
    rows = packed.join(fields, "layer_id").join(structures, "document_id").where(controls.applies(F.col("structure"), F.col("applies_to")))
    return rows.select("document_id", F.col("qualified_id").alias("qualified_layer_id"), "chunk_index", "field_name", "page_map")


def refusals(ingested: dict[str, DataFrame], packed: DataFrame, estimates: DataFrame | None = None, ceiling: float | None = None) -> DataFrame:
    """``document_id, reason`` of documents that must not be read: no layer in scope,
    or a high bound of the cost beyond the ceiling."""
    without = ingested["documents"].select("document_id").join(packed.select("document_id").distinct(), "document_id", "left_anti")
    out = without.withColumn("reason", F.lit("no layer to read"))
    if ceiling is not None:
        dear = readings.within_ceiling(estimates, ceiling).where(~F.col("allowed"))
        out = out.unionByName(dear.select("document_id", F.concat(F.lit("estimated cost of up to "), F.round("cost_high", 2).cast("string"), F.lit(" is beyond the ceiling")).alias("reason")))
    return out


def estimates(ingested: dict[str, DataFrame], overhead_tokens: int, prices: DataFrame, model_id: str = "standard", layer_ids: Sequence[str] = dims.EXTRACTABLE_LAYERS) -> DataFrame:
    """Cost bounds of each layer in scope, over the body pages that would be sent."""
    body = _body(ingested, layer_ids)
    return readings.estimate(body, ["document_id", "qualified_id"], prices, overhead_tokens, model_id)


def extract(ingested: dict[str, DataFrame], model_readings: DataFrame, run_id: str, *, registry: DataFrame | None = None, scope: DataFrame | None = None, overhead_tokens: int = 0, compose: bool = True, refused: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """Controlled, reconciled fields of all documents, with inapplicable fields once each.

    Documents in ``refused`` (document_id, reason) get no rows. ``failures``
    (document_id, qualified_layer_id, reason) are layers whose requests failed:
    their fields are unresolved and say why, other layers are not touched.
    """
    spark = model_readings.sparkSession
    registry = dims.field_registry(spark) if registry is None else registry
    scope = dims.layer_scope(spark) if scope is None else scope
    wanted = asked(ingested, requests(ingested, overhead_tokens), registry, scope)
    structures = ingested["structures"]
    if refused is not None:
        wanted = wanted.join(refused.select("document_id").distinct(), "document_id", "left_anti")
        structures = structures.join(refused.select("document_id").distinct(), "document_id", "left_anti")
    if failures is not None:
        model_readings = model_readings.join(failures.select("document_id", "qualified_layer_id").distinct(), ["document_id", "qualified_layer_id"], "left_anti")
    records = readings.to_records(readings.index_readings(model_readings.drop("page_map"), wanted)).withColumn("run_id", F.lit(run_id))
    if failures is not None:
        why = failures.groupBy("document_id", F.col("qualified_layer_id").alias("document_layer")).agg(F.min("reason").alias("_why"))
        told = F.when(F.col("_why").isNotNull(), F.array(F.concat(F.lit("the layer's request failed: "), F.col("_why")))).otherwise(F.col("notes"))
        records = records.join(why, ["document_id", "document_layer"], "left").withColumn("notes", told).drop("_why")
    placed = layers.with_locators(records, ingested["reconciled"], ingested["document_layers"], compose)
    text = ingested["reconciled"].select("document_id", "pdf_page", F.col("text").alias("page_text"))
    checked = controls.apply_controls(placed.join(text, ["document_id", "pdf_page"], "left"), registry, compose=compose)
    met = readings.reconcile(readings.keep_omitted(checked, records))
    blind = layers.unreadable_in_scope(ingested["reconciled"], ingested["document_layers"], ingested["document_regions"])
    met = readings.qualify_absences(met, blind)
    absent = controls.not_applicable_rows(structures, registry, F.lit(run_id))
    return schemas.conform(met.unionByName(absent, allowMissingColumns=True), schemas.EXTRACTED_FIELDS)


def counts(documents: DataFrame, fields: DataFrame, issues: DataFrame) -> DataFrame:
    """Inventory of a store: fields found, withheld and absent, and issues, per document."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    f = fields.groupBy("document_id").agg(of("found").alias("found"), of("unresolved", "conflict").alias("withheld"), of("not_found").alias("not_found"), of("not_applicable").alias("not_applicable"), F.count_if(F.col("review_status") == "exception").alias("in_review"))
    i = issues.groupBy("document_id").agg(F.count(F.lit(1)).alias("issues"))
    names = ("found", "withheld", "not_found", "not_applicable", "in_review", "issues")
    return documents.select("document_id", "filename").join(f, "document_id", "left").join(i, "document_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls included, beside its document."""
    return df.select("document_id", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
