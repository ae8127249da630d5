"""Filing files as a table: checksums, ids, metadata dates, and pages where a PDF
library is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import document_id


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with checksum, id and name; content stays a column."""
    raw = spark.read.format("binaryFile").load(path)
    sum_ = F.sha2("content", 256)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), sum_.alias("checksum"), document_id(sum_).alias("document_id"), F.col("modificationTime").alias("modified_at"), "content")


def metadata_date(raw: Column) -> Column:
    """The first run of eight digits as a date; null where it is none."""
    digits = F.regexp_extract(raw, r"(\d{8})", 1)
    return F.try_to_date(F.when(digits != "", digits), "yyyyMMdd")


PAGES = "document_id string, pdf_page int, text string, has_images boolean"


def pages(found: DataFrame) -> DataFrame:
    """Pages of PDF files; a page that fails is empty text, a file that fails is an error."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for batch in batches:
            for doc, content in zip(batch["document_id"], batch["content"], strict=True):
                rows = []
                for n, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
                    try:
                        text = page.extract_text() or ""
                    except Exception:
                        text = ""
                    try:
                        images = len(page.images) > 0
                    except Exception:
                        images = False
                    rows.append((doc, n, text, images))
                yield pd.DataFrame(rows, columns=["document_id", "pdf_page", "text", "has_images"])

    return found.select("document_id", "content").mapInPandas(explode, PAGES)
