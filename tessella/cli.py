"""Command line: export a store, or price a run.

    python -m tessella.cli export STORE OUT
    python -m tessella.cli estimate STORE [--model NAME] [--overhead TOKENS]

Exit codes: 1 no store, 2 nothing to export, or unreadable pages in an estimate.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella import dims
from tessella.operators import filing, layers, readings
from tessella.sources import store


def export(spark: SparkSession, root: str, out: str) -> int:
    """One JSON folder partitioned by file name, and the workbook's sheets."""
    s = store.Store(spark, root)
    if not s.exists("documents"):
        return 1
    documents = s.read("documents")
    if documents.isEmpty() or not s.exists("extracted_fields"):
        return 2
    fields = s.read("extracted_fields")
    slug = F.regexp_replace(F.regexp_replace("filename", r"\.[^.]*$", ""), r"[^A-Za-z0-9]+", "-")
    names = documents.select("document_id", F.lower(slug).alias("filing"))
    store.export_records(fields).join(names, "document_id").write.mode("overwrite").partitionBy("filing").json(f"{out}/records")
    sheets = {n: s.read(n) for n in ("documents", *store.CHILDREN, "extracted_fields", "runs") if s.exists(n)}
    sheets = {n: df.drop("text", "content") for n, df in sheets.items()}
    store.write_workbook(sheets | store.derived(fields, documents) | {"assumptions": store.assumptions(spark, dims.ASSUMPTIONS)}, f"{out}/workbook")
    return 0


def estimate(spark: SparkSession, root: str, model: str, overhead: int | None) -> int:
    """Print the estimate of every layer in scope, over its body pages, row by row."""
    s = store.Store(spark, root)
    if not s.exists("document_pages"):
        return 1
    ingested = {n: s.read(n) for n in ("document_pages", "document_layers", "document_regions")}
    overhead = readings.field_overhead(dims.field_registry(spark)) if overhead is None else overhead
    rows = filing.estimates(ingested, overhead, dims.model_prices(spark), model).orderBy("document_id", "qualified_id")
    print(*rows.columns, sep="\t")
    for row in rows.toLocalIterator():
        print(*row, sep="\t")
    blind = layers.unreadable_in_scope(ingested["document_pages"], ingested["document_layers"], ingested["document_regions"])
    return 0 if blind.isEmpty() else 2


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tessella")
    sub = parser.add_subparsers(dest="what", required=True)
    e = sub.add_parser("export")
    e.add_argument("store")
    e.add_argument("out")
    p = sub.add_parser("estimate")
    p.add_argument("store")
    p.add_argument("--model", default=dims.MODEL_PRICES[0][0])
    p.add_argument("--overhead", type=int, default=None, help="tokens of a request beside its pages; by default what naming the fields takes")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    return export(spark, a.store, a.out) if a.what == "export" else estimate(spark, a.store, a.model, a.overhead)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
