"""Schemas of the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = "document_id string, pdf_page int, text string, has_images boolean"

DOCUMENTS = (
    "document_id string, checksum string, filename string, source_url string, page_count int, total_chars long, "
    "is_machine_readable boolean, requires_ocr boolean, ingestion_status string, transaction_structure string, "
    "structure_confidence double, filing_date date, ingestion_version string, schema_version string, run_id string, ingested_at timestamp"
)

MODEL_READINGS = (
    "document_id string, qualified_layer_id string, chunk_index int, reading_index int, field_name string, found boolean, "
    "raw_value string, page int, section string, evidence string, confidence double, run_id string, model_id string, prompt_version string"
)

EXTRACTED_FIELDS = (
    "document_id string, field_name string, category string, document_layer string, value_num double, value_text string, "
    "value_bool boolean, currency string, raw_value string, pdf_page int, printed_page string, section string, evidence string, "
    "locator_uri string, extraction_method string, confidence double, status string, review_status string, "
    "normalization_status string, evidence_verified boolean, is_critical boolean, notes array<string>, model_id string, "
    "prompt_version string, run_id string"
)

CORRECTIONS = (
    "document_id string, field_name string, document_layer string, run_id string, edit_seq long, raw_value string, "
    "evidence string, printed_page string, pdf_page int, section string, reviewer_note string"
)

DECISIONS = "document_id string, field_name string, document_layer string, run_id string, edit_seq long, review_status string, note string"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` in the columns and types of a schema; what is missing is null, what is
    not in it goes."""
    kinds = [x.strip().split(" ", 1) for x in schema.split(", ")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds])
