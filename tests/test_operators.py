"""Operators on small filings and field tables, against known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella import dims, schemas
from tessella.operators import compare, context, controls, layers, pages, pricing, readings, review, structure, timeline
from tessella.sources import filings, store

NAMES = [x.strip().split(" ")[0] for x in schemas.EXTRACTED_FIELDS.split(", ")]


def rows_of(spark, *rows, **more):
    base = {"document_id": "d", "confidence": 0.9, "status": "found", "review_status": "unreviewed", "run_id": "r", "evidence": "q", "pdf_page": 5, "notes": []}
    data = []
    for r in rows:
        full = base | more | r
        data.append(tuple(full.get(n) for n in NAMES))
    return spark.createDataFrame(data, schemas.EXTRACTED_FIELDS)


def pages_of(spark, texts, images=(), doc="d"):
    return spark.createDataFrame([(doc, i, t, i in images) for i, t in enumerate(texts, 1)], schemas.PAGES)


def pair(spark, field, summary, agreement):
    sides = []
    for layer, reading in (("filing-summary", summary), ("agreement-ex2.1", agreement)):
        if reading is not None:
            sides.append({"field_name": field, "document_layer": layer} | reading)
    return compare.compare(rows_of(spark, *sides)).first()


def num(v, raw, **more):
    return {"value_num": v, "raw_value": raw} | more


def txt(v, **more):
    return {"value_text": v, "raw_value": v} | more


ABSENT = {"status": "not_found", "evidence": None, "pdf_page": None, "confidence": 0.0}
PROSE = "The purchaser has committed financing and will draw on the facilities that the lenders have agreed to provide of "


@pytest.mark.parametrize(
    ("field", "summary", "agreement", "expected"),
    [
        ("consideration_per_share", num(73.0, "$73.00"), num(73.0, "$73.00"), "match"),
        ("company_termination_fee", num(250e6, "$250 million"), num(250e6, "$250,000,000"), "normalized_match"),
        ("target", txt("ACME  CORP"), txt("Acme Corp"), "normalized_match"),
        ("target", txt("Acme"), txt("Acme Corporation"), "normalized_match"),
        ("target", txt("Acme"), txt("Other Corporation"), "conflict"),
        ("company_termination_fee", num(250e6, "$250 million"), num(255e6, "$255 million"), "conflict"),
        ("consideration_per_share", num(73.0, "73", currency="USD"), num(73.0, "73", currency="EUR"), "conflict"),
        ("total_transaction_value", num(5.7e9, "$5.7bn"), ABSENT, "summary_only"),
        ("matching_rights", ABSENT, txt("four days"), "agreement_only"),
        ("bridge_amount", ABSENT, ABSENT, "unresolved"),
        ("company_termination_fee", {"status": "unresolved", "raw_value": "x"}, {"status": "unresolved", "raw_value": "x"}, "unresolved"),
        ("shareholder_approval_threshold", {"status": "not_applicable"}, txt("majority"), "not_applicable"),
        ("committed_financing", txt(PROSE + "€14.2bn"), txt(PROSE + "€11.5bn"), "conflict"),
        ("committed_financing", txt("a bridge of €14.2bn"), txt(PROSE + "EUR 14.2 billion"), "normalized_match"),
        ("fee_triggers", txt(PROSE + "Section 8.1"), txt(PROSE + "Clause 9.4(b)"), "normalized_match"),
    ],
)
def test_comparison_classes(spark, field, summary, agreement, expected):
    got = pair(spark, field, summary, agreement)
    assert got["classification"] == expected
    assert got["needs_review"] == (expected == "conflict" or (expected == "unresolved" and summary.get("raw_value") is not None))
    if expected in ("match", "normalized_match", "conflict", "agreement_only"):
        assert got["preferred"]["document_layer"] == "agreement-ex2.1"


def test_comparison_picks_the_best_reading_and_counts(spark):
    rows = rows_of(
        spark,
        {"field_name": "target", "document_layer": "agreement-ex2.1", "confidence": 0.6} | txt("A"),
        {"field_name": "target", "document_layer": "agreement-1", "confidence": 0.8} | txt("B"),
        {"field_name": "target", "document_layer": "agreement", "confidence": 0.99, "status": "unresolved", "raw_value": "C"},
        {"field_name": "acquirer", "document_layer": "filing-summary"} | txt("P"),
    )
    got = compare.compare(rows)
    assert {r["field_name"]: r["preferred"]["value_text"] for r in got.collect()} == {"target": "B", "acquirer": "P"}
    assert [(r["classification"], r["n_fields"]) for r in compare.class_counts(got).collect()] == [("agreement_only", 1), ("summary_only", 1)]
    assert [r["field_name"] for r in compare.in_triage_order(got).collect()] == ["target", "acquirer"]
    assert len(compare.flat(got).columns) == 27 and compare.flat(got).count() == 2
    assert compare.compare(rows, run_id="other").count() == 0


def test_page_integrity(spark):
    body = "word " * 80
    p = pages.prepare(pages_of(spark, [body + "one\n1", body + "two\n2", body + "two\n2", "", "short", "", body + "x\n7"], images={6}))
    got = {r["pdf_page"]: r["text_layer_status"] for r in p.collect()}
    assert got == {1: "machine_readable", 2: "machine_readable", 3: "machine_readable", 4: "blank", 5: "blank", 6: "image_only", 7: "machine_readable"}
    dup = pages.duplicate_issues(p).collect()
    assert [(d["pdf_pages"], d["severity"]) for d in dup] == [([2, 3], "error")]
    s = pages.ingestion_status(pages.reconcile_labels(p)).first()
    assert s["requires_ocr"] and s["ingestion_status"] == "ocr_required" and not s["is_machine_readable"]
    assert pages.integrity_issues(pages.reconcile_labels(p)).where("issue_order = 0").count() == 1


def test_blank_pages_are_no_duplicates(spark):
    p = pages.prepare(pages_of(spark, ["", "", ""]))
    assert pages.duplicate_issues(p).count() == 0
    assert pages.readability(p).first()["blank"] == [1, 2, 3]
    assert pages.ingestion_status(pages.reconcile_labels(p)).first()["ingestion_status"] != "ocr_required"


def test_label_reconciliation(spark):
    one = pages.reconcile_labels(pages.prepare(pages_of(spark, ["text", "text\n62", "text", "text"])))
    assert {r["pdf_page"]: r["label_source"] for r in one.collect()} == {1: "absent", 2: "rejected", 3: "absent", 4: "absent"}
    run = pages.reconcile_labels(pages.prepare(pages_of(spark, ["cover", "t\n1", "t\n2", "t\n3", "t\n4"])))
    assert [r["label_source"] for r in run.orderBy("pdf_page").collect()] == ["absent", *["reconciled"] * 4]
    gap = pages.reconcile_labels(pages.prepare(pages_of(spark, ["t\n1", "t\n2", "t", "t\n4", "t\n5", "t", "t", "t\n8"])))
    found = {tuple(r["pdf_pages"]): r["severity"] for r in pages.label_issues(gap).collect()}
    assert found == {(3,): "info", (6, 7): "warning"}


FILING = ["UNITED STATES SECURITIES AND EXCHANGE COMMISSION\nFORM 8-K", "Item 1.01 text", "EXHIBIT 2.1\nAGREEMENT AND PLAN OF MERGER", "TABLE OF CONTENTS\n1\n2", "Merger Sub shall merge. Effective Time. As in Exhibit A to this long sentence of prose", "IN WITNESS WHEREOF", "EXHIBIT 10.1\nBRIDGE CREDIT AGREEMENT", "loan text"]


def test_segmentation(spark):
    p = pages_of(spark, FILING).unionByName(pages_of(spark, ["plain", "pages"], doc="e"))
    found = layers.segment_layers(p)
    got = sorted((r["document_id"], r["start_page"], r["end_page"], r["qualified_id"]) for r in found.collect())
    assert got == [("d", 1, 2, "filing-summary"), ("d", 3, 6, "agreement-ex2.1"), ("d", 7, 8, "credit-agreement-ex10.1"), ("e", 1, 2, "unknown")]
    regions = layers.segment_regions(p, found)
    inside = sorted((r["start_page"], r["end_page"], r["region_id"]) for r in regions.where("qualified_id = 'agreement-ex2.1'").collect())
    assert inside == [(3, 3, "body"), (4, 5, "table-of-contents"), (6, 6, "signature")]
    assert [r["pdf_page"] for r in layers.body_pages(p, found, regions).where("qualified_id = 'agreement-ex2.1'").orderBy("pdf_page").collect()] == [3, 6]
    assert {r["document_id"]: r["pdf_page"] for r in layers.pages_to_scan(p, found, regions).groupBy("document_id").agg(F.count("*").alias("pdf_page")).collect()} == {"d": 2, "e": 2}
    assert {r["document_id"]: len(r["warnings"]) for r in layers.warnings(found, structure.classify(p, structure.scores(structure.evidence(p)))).collect()} == {"d": 0, "e": 3}
    assert layers.layer_of_kind(found, "agreement").first()["qualified_id"] == "agreement-ex2.1"


def test_long_contents_split(spark):
    toc = "TABLE OF CONTENTS\n" + "\n".join(f"Section\n{i}" for i in range(6))
    p = pages_of(spark, [toc, *[toc.replace("TABLE OF CONTENTS\n", "")] * 2, *["body text"] * 6])
    got = sorted((r["start_page"], r["end_page"], r["region_id"]) for r in layers.segment_regions(p, layers.segment_layers(p)).collect())
    assert got == [(1, 3, "table-of-contents"), (4, 9, "body")]


def test_structure(spark):
    classify = lambda texts: structure.classify(pages_of(spark, texts), structure.scores(structure.evidence(pages_of(spark, texts)))).first()
    merger = classify(["Agreement and Plan of Merger. Merger Sub. Effective Time. Surviving Corporation", "Merger Sub again"])
    assert (merger["structure"], merger["confidence"], merger["review_status"]) == ("merger", 1.0, "unreviewed")
    hybrid = classify(["Offer to Purchase; Schedule TO; validly tendered", "Agreement and Plan of Merger; Merger Sub; Effective Time"])
    assert hybrid["structure"] == "tender_offer" and hybrid["secondary_structures"] == ["merger"] and hybrid["review_status"] == "exception"
    assert classify(["nothing here"])["structure"] == "unknown"
    assert classify(["the Effective Time"])["confidence"] == 0.2


@pytest.mark.parametrize(
    ("field", "reading", "status", "verified"),
    [
        ("matching_rights", {"raw_value": "four days", "confidence": 0.70}, "found", True),
        ("company_termination_fee", {"raw_value": "$250 million", "confidence": 0.70}, "unresolved", True),
        ("company_termination_fee", {"raw_value": "up to $250 million", "confidence": 0.95}, "unresolved", True),
        ("outside_date", {"raw_value": "the first anniversary of the date hereof", "confidence": 0.99}, "unresolved", True),
        ("target", {"raw_value": "Acme", "evidence": None, "confidence": 0.99}, "unresolved", False),
        ("target", {"raw_value": "Acme", "evidence": "not there", "confidence": 0.99}, "unresolved", False),
        ("target", {"raw_value": "Acme", "pdf_page": None, "confidence": 0.99}, "unresolved", False),
        ("target", {"raw_value": "  ", "confidence": 0.99}, "not_found", None),
        ("target", {"raw_value": "x", "status": "not_applicable"}, "not_applicable", None),
        ("no_such_field", {"raw_value": "x"}, "unresolved", None),
    ],
)
def test_controls(spark, field, reading, status, verified):
    from tessella.functions import text

    base = {"field_name": field, "document_layer": "agreement", "evidence": "the quote", "extraction_method": "llm"}
    rows = rows_of(spark, base | reading)
    rows = rows.withColumn("locator_uri", text.locator_uri(F.col("document_id"), F.col("document_layer"), F.coalesce("pdf_page", F.lit(0)), F.lit(None).cast("string"), text.anchor(F.col("evidence"))))
    out = controls.apply_controls(rows.withColumn("page_text", F.lit("Here is THE  quote.")), dims.field_registry(spark)).first()
    assert (out["status"], out["evidence_verified"]) == (status, verified)
    assert (out["review_status"] == "exception") == (status == "unresolved")
    has = any(out[c] is not None for c in compare.VALUE)
    assert has == (status == "found")


def test_missing_page_fails_closed(spark):
    rows = rows_of(spark, {"field_name": "target", "document_layer": "agreement", "raw_value": "A", "locator_uri": "src://d/agreement/pdf:5#0123456789abcdef"}).withColumn("page_text", F.lit(None).cast("string"))
    assert controls.apply_controls(rows, dims.field_registry(spark)).first()["status"] == "unresolved"
    assert controls.apply_controls(rows, dims.field_registry(spark), verify=False).first()["status"] == "found"


def test_registry_scopes(spark):
    r = dims.field_registry(spark)
    assert [controls.fields_for(r, s).count() for s in ("merger", "tender_offer", None, "unknown")] == [48, 49, 50, 50]
    assert controls.fields_for(r, "merger", applicable=False).count() == 2
    assert [len(x["fields"]) for x in controls.fields_by_category(r).collect()] == [10, 5, 9, 8, 10, 8]
    assert dims.layer_scope(spark).where("layer_id = 'credit-agreement'").count() == 1


def reading_rows(spark, *readings_):
    cols = schemas.MODEL_READINGS
    names = [c.split(" ")[0] for c in cols.split(", ")]
    base = {"document_id": "d", "qualified_layer_id": "agreement", "chunk_index": 0, "reading_index": 0, "run_id": "r", "found": True, "page": 1, "evidence": "q", "confidence": 0.9}
    return spark.createDataFrame([tuple((base | x).get(n) for n in names) for x in readings_], cols)


def test_readings_to_records(spark):
    asked = spark.createDataFrame([("d", "agreement", 0, f, [5, 6]) for f in ("target", "acquirer", "guarantors")], "document_id string, qualified_layer_id string, chunk_index int, field_name string, page_map array<int>")
    got = reading_rows(spark, {"field_name": "target", "raw_value": " Acme ", "page": 2, "confidence": 1.4}, {"field_name": "acquirer", "raw_value": "B", "page": 999}, {"field_name": "odd", "raw_value": "x"})
    records = {r["field_name"]: r for r in readings.to_records(readings.index_readings(got, asked)).collect()}
    assert (records["target"]["raw_value"], records["target"]["pdf_page"], records["target"]["confidence"]) == ("Acme", 6, 1.0)
    assert records["acquirer"]["pdf_page"] is None and records["acquirer"]["notes"]
    assert (records["guarantors"]["status"], records["guarantors"]["review_status"]) == ("unresolved", "exception")
    assert readings.unknown_names(got, asked).first()["names"] == ["odd"]


def test_reconciliation(spark):
    def met(*values):
        rows = rows_of(spark, *[{"field_name": "company_termination_fee", "document_layer": "agreement"} | v for v in values])
        keyed = rows.coalesce(1).withColumn("chunk_index", F.monotonically_increasing_id().cast("int")).withColumn("reading_index", F.lit(0))
        return readings.reconcile(keyed).first()

    same = met(num(250e6, "a", confidence=0.8), num(250e6, "b", confidence=0.95))
    assert same["status"] == "found" and same["confidence"] == 0.95 and "corroborated" in same["notes"][0]
    clash = met(num(250e6, "a"), num(300e6, "b"))
    assert clash["status"] == "conflict" and clash["value_num"] is None and "250000000" in str(clash["notes"]) and "300000000" in str(clash["notes"])
    assert met(dict(ABSENT), {"status": "unresolved", "raw_value": "x"})["status"] == "unresolved"


def test_packing_and_estimate(spark):
    p = pages_of(spark, ["x" * 290] * 500).withColumn("char_count", F.length("text"))
    assert len(readings.pack_pages(p, ["document_id"]).first()["chunks"]) == 1
    small = readings.pack_pages(p, ["document_id"], budget=F.lit(1000).cast("long")).first()["chunks"]
    assert len(small) > 1 and [x for c in small for x in c] == list(range(1, 501))
    assert readings.pack_pages(p, ["document_id"], budget=F.lit(50).cast("long")).first()["oversized"] == list(range(1, 501))
    assert len(readings.pack_pages(p, ["document_id"], page_limit=F.lit(100)).first()["chunks"]) == 5
    cut = readings.excerpts(p.limit(3), readings.pack_pages(p.limit(3), ["document_id"], page_limit=F.lit(2)), ["document_id"])
    assert sorted(r["excerpt"].count("[PAGE 1]") for r in cut.collect()) == [1, 1]
    cost = readings.estimate(p, ["document_id"], dims.model_prices(spark), 1000)
    got = cost.first()
    assert got["requests"] == 1 and got["cost_low"] < got["cost_high"]
    assert readings.within_ceiling(cost, 0.01).first()["allowed"] is False
    with pytest.raises(Exception, match="unknown model profile"):
        readings.estimate(p, ["document_id"], dims.model_prices(spark), 1000, "nobody").collect()


def deal(spark, clause="two successive periods of ninety (90) days", **more):
    at = {"document_layer": "agreement-ex2.1", "printed_page": "A-9", "pdf_page": 9, "confidence": 0.95}
    return rows_of(spark, at | {"field_name": "agreement_date"} | txt("2026-06-25"), at | {"field_name": "outside_date"} | txt("2027-06-25"), at | {"field_name": "extension_conditions"} | txt(clause), at | {"field_name": "antitrust_approvals"} | txt("HSR"), at | {"field_name": "no_injunction_condition"} | txt("none"))


def test_timeline_and_horizon(spark):
    c = compare.compare(deal(spark))
    t = timeline.build(c)
    made = timeline.calculated(t).orderBy("resolved_date").collect()
    assert [(r["resolved_date"].isoformat(), r["derivation"], r["page"]) for r in made] == [("2027-09-23", "2027-06-25 + 1 x 90 days", "A-9"), ("2027-12-22", "2027-06-25 + 2 x 90 days", "A-9")]
    h = timeline.horizon(c).first()
    assert (h["base_days"], h["extension_days"], h["total_days"], h["final_outside_date"], h["outstanding_conditions"]) == (365, 180, 545, dt.date(2027, 12, 22), 2)
    assert timeline.anchored(t).count() == 4 and timeline.unanchored(t).count() == 3
    months = timeline.calculated(timeline.build(compare.compare(deal(spark, "by three (3) months")))).first()
    assert months["resolved_date"].isoformat() == "2027-09-23" and "30 days" in months["derivation"]
    vague = compare.compare(deal(spark, "as agreed"))
    assert timeline.horizon(vague).first()["total_days"] == 365


GRID = {
    "rates_up_25": (-65e6, 0, -39e6),
    "rates_down_25": (65e6, 0, -39e6),
    "rates_up_50": (-130e6, 0, -39e6),
    "rates_and_credit": (-117e6, -52e6, -91e6),
    "delay_first_extension": (0, -1_479_452.05, -39e6),
    "delay_final_extension": (0, -2_958_904.11, -39e6),
    "transaction_failure": (0, -5.2e6, -39e6),
}


def test_scenario_grid(spark):
    rows = deal(spark)
    c = compare.compare(rows)
    inputs = pricing.financing(c, pricing.found_values(rows, c))
    run = pricing.run(timeline.horizon(c), inputs)
    assert run.groupBy("scenario_id", "strategy").count().select("count").distinct().first()[0] == 7
    got = {(r["scenario_id"], r["strategy"]): r for r in pricing.net(run).collect()}
    for s, values in GRID.items():
        for strategy, v in zip(dims.STRATEGIES, values, strict=True):
            assert got[s, strategy]["net_pnl"] == pytest.approx(v, abs=0.01)
    expected = {r["strategy"]: r["expected_pnl"] for r in pricing.expected(pricing.net(run)).collect()}
    assert [expected[s] for s in dims.STRATEGIES] == [pytest.approx(0), pytest.approx(-481_917.81, abs=0.01), pytest.approx(-5_850_000)]
    # without dates both delays are listed and cost nothing, the premium included
    none = pricing.net(pricing.run(timeline.horizon(c).withColumn("extension_dates", F.array().cast("array<date>")), inputs))
    assert {r["net_pnl"] for r in none.where("scenario_id like 'delay%'").collect()} == {0.0}
    first = timeline.horizon(c).withColumn("extension_dates", F.slice("extension_dates", 1, 1))
    one = pricing.scenarios(first)
    assert one.count() == 6 and one.where("scenario_id = 'delay_first_extension'").first()["probability"] == 0.10


def test_financing_prefers_the_filing(spark):
    at = {"document_layer": "credit-agreement-ex10.1"}
    rows = rows_of(spark, at | {"field_name": "bridge_amount"} | num(11.5e9, "€11.5bn"), at | {"field_name": "bridge_currency"} | txt("EUR"), at | {"field_name": "bridge_maturity"} | txt("364 days after the Closing Date"))
    c = compare.compare(rows.unionByName(rows_of(spark, {"field_name": "target", "document_layer": "agreement"} | txt("A"))))
    got = pricing.financing(c, pricing.found_values(rows, c)).first()
    assert (got["notional"], got["notional_source"], got["currency"], got["tenor_years"], got["has_fx_exposure"]) == (11.5e9, "extracted", "EUR", 0.997, True)
    assert got["dv01"] == pytest.approx(1_064_654, rel=1e-3)
    assert pricing.exposures(pricing.financing(c, pricing.found_values(rows, c)), assumed_notional=False).count() == 3


def test_review(spark):
    rows = rows_of(spark, {"field_name": "company_termination_fee", "document_layer": "filing-summary", "is_critical": True} | num(250e6, "$250m"), {"field_name": "company_termination_fee", "document_layer": "agreement", "is_critical": True} | num(255e6, "$255m"), {"field_name": "target", "document_layer": "agreement", "review_status": "exception", "status": "unresolved", "raw_value": "x"})
    found = review.items(rows, compare.compare(rows)).collect()
    assert [(r["review_reason"], r["document_layer"]) for r in found] == [("layer_conflict", "agreement"), ("layer_conflict", "filing-summary"), ("control_exception", "agreement")]
    assert found[0]["conflict_with"]["value_num"] == 250e6
    edits = spark.createDataFrame(
        [("d", "target", "agreement", "r", 1, "Acme", "the quote", None, 5, None, "seen"), ("d", "company_termination_fee", "agreement", "r", 1, "soon", "q", None, 5, None, None), ("d", "company_termination_fee", "agreement", "r", 2, " ", "q", None, 5, None, None), ("d", "nothing", "agreement", "r", 1, "x", "q", None, 5, None, None), ("d", "company_termination_fee", "filing-summary", "r", 1, "€250,000,000", "absent words", None, 6, None, None)],
        schemas.CORRECTIONS,
    )
    p = spark.createDataFrame([("d", 5, "here is the quote", "A-5"), ("d", 6, "other", "A-6")], "document_id string, pdf_page int, text string, printed_page string")
    judged = review.judge_corrections(edits, rows, dims.field_registry(spark), p)
    assert {(r["field_name"], r["document_layer"], r["edit_seq"]): r["accepted"] for r in judged.collect()} == {("target", "agreement", 1): True, ("company_termination_fee", "agreement", 1): False, ("company_termination_fee", "agreement", 2): False, ("nothing", "agreement", 1): False, ("company_termination_fee", "filing-summary", 1): True}
    now = {(r["field_name"], r["document_layer"]): r for r in review.overlay(rows, judged).collect()}
    fixed = now["target", "agreement"]
    assert (fixed["status"], fixed["review_status"], fixed["confidence"], fixed["value_text"], fixed["extraction_method"], fixed["evidence_verified"], fixed["printed_page"]) == ("found", "verified", 1.0, "Acme", "hybrid", True, "A-5")
    fee = now["company_termination_fee", "filing-summary"]
    assert (fee["currency"], fee["evidence_verified"], fee["printed_page"]) == ("EUR", False, "A-6") and any("quote" in n for n in fee["notes"])
    assert now["company_termination_fee", "agreement"]["value_num"] == 255e6
    left = review.items(review.overlay(rows, judged), compare.compare(review.overlay(rows, judged))).collect()
    assert [r["document_layer"] for r in left] == ["agreement"]
    said = spark.createDataFrame([("d", "target", "agreement", "r", 1, "verified", "ok"), ("d", "target", "agreement", "r", 2, "odd", "no")], schemas.DECISIONS)
    assert {r["review_status"] for r in review.with_decisions(rows, said).where("field_name = 'target'").collect()} == {"verified"}


def test_context(spark):
    rows = rows_of(spark, {"field_name": "consideration_per_share", "document_layer": "agreement", "printed_page": "A-9"} | num(73.0, "$73"), {"field_name": "target", "document_layer": "agreement", "status": "unresolved", "raw_value": "no"})
    line = context.context(rows).first()
    assert "73.0" in line["context"] and "A-9" in line["context"] and "0.90" in line["context"] and line["n_fields"] == 1
    asks = spark.createDataFrame([("d", "How much?"), ("e", "Who?")], "document_id string, question string")
    got = {r["document_id"]: (r["ask_model"], r["answer"]) for r in context.gate(asks, rows).collect()}
    assert got == {"d": (True, None), "e": (False, context.NOTHING)}


def test_store_round_trip(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([("d", "sum1", "f.pdf"), ("e", "sum2", "g.pdf")], "document_id string, checksum string, filename string").withColumn("ingested_at", F.current_timestamp())
    p = pages_of(spark, ["a", "b"]).unionByName(pages_of(spark, ["c"], doc="e"))
    s.save_ingestion({"documents": docs, "document_pages": p})
    rows = rows_of(spark, {"field_name": "target", "document_layer": "agreement"} | txt("A"), {"field_name": "fee", "document_layer": "agreement", "run_id": "r2"} | num(1.5, "x"))
    assert s.save_extraction(rows) == 2
    s.save_ingestion({"documents": docs.where("document_id = 'd'"), "document_pages": pages_of(spark, ["new"])})
    assert {(r["document_id"], r["text"]) for r in s.read("document_pages").collect()} == {("d", "new"), ("e", "c")}
    assert s.documents().count() == 2 and s.fields("d").count() == 2 and s.fields("d", run_id="r2").count() == 1
    assert s.save_extraction(rows_of(spark, {"field_name": "target", "document_layer": "agreement"} | txt("B"))) == 1
    assert {r["value_text"] for r in s.fields("d", layer="agreement", run_id="r").collect()} == {"B"} and s.fields("d").count() == 2
    s.record_run(spark.createDataFrame([("r", "1")], "run_id string, version string"))
    s.record_run(spark.createDataFrame([("r", "2"), ("q", "1")], "run_id string, version string"))
    assert {(r[0], r[1]) for r in s.read("runs").collect()} == {("r", "1"), ("q", "1")}
    assert s.unseen(spark.createDataFrame([("sum1",), ("sum9",)], "checksum string")).count() == 1
    broken = docs.withColumn("checksum", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        s.save_ingestion({"document_pages": pages_of(spark, ["lost"]), "documents": broken})
    assert s.read("document_pages").where("text = 'lost'").count() == 0
    frames = store.derived(rows, docs)
    store.write_workbook(frames | {"empty": docs.limit(0)}, str(tmp_path / "book"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "book/empty")).columns == ["note"]
    assert store.export_records(rows).columns == list(store.EXPORT_KEYS)
    assert '"normalized_value":"1.5"' in store.export_json(rows.where("field_name = 'fee'")).first()["record"]


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    got = filings.files(spark, str(tmp_path)).first()
    assert got["checksum"].startswith("ba7816bf") and got["document_id"] == "doc_ba7816bf8f01"
    d = spark.createDataFrame([("D:20260625101010",), ("20269999",), ("none",)], "x string").select(filings.metadata_date(F.col("x")).alias("d")).collect()
    assert [r["d"] for r in d] == [dt.date(2026, 6, 25), None, None]
