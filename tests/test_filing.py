"""End to end: pages and model readings to a store, its exports, and a file stream."""

import pytest
from pyspark.sql import functions as F

from tessella import cli, schemas
from tessella.operators import compare, filing, readings
from tessella.sources import store
from tessella.streaming import files

PAGES = ["UNITED STATES SECURITIES AND EXCHANGE COMMISSION FORM 8-K CURRENT REPORT", "Item 1.01 Acme pays a fee of $250 million", "EXHIBIT 2.1\nAGREEMENT AND PLAN OF MERGER", "The Merger Sub and the Effective Time. The fee is $255 million.\n1", "The Outside Date is June 25, 2027.\n2", "Surviving Corporation\n3", "plain text of the agreement\n4"]


def readings_of(spark, *rows):
    names = [c.split(" ")[0] for c in schemas.MODEL_READINGS.split(", ")]
    base = {"document_id": "d", "chunk_index": 0, "reading_index": 0, "found": True, "confidence": 0.95, "run_id": "r"}
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], schemas.MODEL_READINGS)


@pytest.fixture(scope="module")
def done(spark):
    pages = spark.createDataFrame([("d", i, t, False) for i, t in enumerate(PAGES, 1)], schemas.PAGES).cache()
    names = spark.createDataFrame([("d", "sum", "Deal Filing.pdf")], "document_id string, checksum string, filename string")
    ingested = filing.ingest(pages, names, "r")
    said = readings_of(
        spark,
        {"qualified_layer_id": "filing-summary", "field_name": "company_termination_fee", "raw_value": "$250 million", "evidence": "fee of $250 million", "page": 2},
        {"qualified_layer_id": "agreement-ex2.1", "field_name": "company_termination_fee", "raw_value": "$255 million", "evidence": "The fee is $255 million", "page": 2},
        {"qualified_layer_id": "agreement-ex2.1", "field_name": "outside_date", "raw_value": "June 25, 2027", "evidence": "Outside Date is June 25, 2027", "page": 3},
        {"qualified_layer_id": "agreement-ex2.1", "field_name": "target", "raw_value": "Acme", "evidence": "never said", "page": 1},
    )
    fields = filing.extract(ingested, said, "r").cache()
    return ingested, fields


def test_ingest_and_extract(done):
    ingested, fields = done
    doc = ingested["documents"].first()
    assert (doc["transaction_structure"], doc["page_count"], doc["ingestion_status"]) == ("merger", 7, "ingested_with_warnings")
    got = {(r["field_name"], r["document_layer"]): r for r in fields.collect()}
    assert len(got) == 2 * 48 + 2
    date = got["outside_date", "agreement-ex2.1"]
    assert (date["status"], date["value_text"], date["printed_page"], date["pdf_page"]) == ("found", "2027-06-25", "2", 5)
    assert got["company_termination_fee", "agreement-ex2.1"]["value_num"] == 255e6
    assert got["target", "agreement-ex2.1"]["status"] == "unresolved" and got["acquirer", "filing-summary"]["status"] == "unresolved"
    assert got["tender_acceptance_threshold", None]["status"] == "not_applicable"
    clash = compare.compare(fields).where("classification = 'conflict'").collect()
    assert [r["field_name"] for r in clash] == ["company_termination_fee"]


def test_store_and_exports(spark, done, tmp_path):
    ingested, fields = done
    root = str(tmp_path / "store")
    assert cli.export(spark, root, str(tmp_path / "out")) == 1
    s = store.Store(spark, root)
    s.save_ingestion({k: v for k, v in ingested.items() if k in ("documents", *store.CHILDREN)})
    assert cli.export(spark, root, str(tmp_path / "out")) == 2
    assert s.save_extraction(fields) == 98
    assert cli.export(spark, root, str(tmp_path / "out")) == 0
    assert spark.read.json(str(tmp_path / "out/records")).where("filing = 'deal-filing'").count() == 98
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/workbook/hedging_scenarios")).count() == 7 * 3 * 7
    assert cli.estimate(spark, root, "standard", 100) == 0
    inventory = filing.counts(s.read("documents"), s.read("extracted_fields"), s.read("integrity_issues")).first()
    assert (inventory["found"], inventory["not_applicable"]) == (3, 2)
    assert '"field_name":"outside_date"' in filing.json_rows(s.read("extracted_fields").where("field_name = 'outside_date'")).first()["json"]


def test_file_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, body in (("a.pdf", b"one"), ("b.pdf", b"one"), ("c.pdf", b"two")):
        (folder / name).write_bytes(body)
    query = files.arriving(spark, str(folder)).drop("content").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count_distinct("checksum"), F.count("*")).first()[:] == (2, 2)


def test_token_totals_and_absences(spark):
    runs = spark.createDataFrame([("d", "r", 10, 2, 3, 4), ("d", "r", 1, 1, 1, 1)], "document_id string, run_id string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long")
    assert readings.token_totals(runs).first()["billed_input_tokens"] == 20
    rows = spark.createDataFrame([("d", "a", "not_found", ["x"]), ("d", "a", "found", []), ("d", "b", "not_found", None)], "document_id string, document_layer string, status string, notes array<string>")
    blind = spark.createDataFrame([("d", "a", 4), ("d", "a", 2)], "document_id string, qualified_id string, pdf_page int")
    got = {(r["document_layer"], r["status"]): r["notes"] for r in readings.qualify_absences(rows, blind).collect()}
    assert "2, 4" in got["a", "not_found"][1] and got["a", "found"] == [] and got["b", "not_found"] is None
