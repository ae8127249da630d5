"""Label runs, controls, reconciliation, review and context on events, line items,
labels and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella import dims
from tessella.functions import text
from tessella.operators import compare, context, controls, pages, readings, review
from tessella.plans.orders import field_rows
from tessella.sources.tables import table


def labelled(spark, sf_dir):
    """Each user's events as pages whose labels are series of the event's type."""
    e = table(spark, sf_dir, "events")
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.withColumn("pdf_page", page)
    label = F.when(F.col("event_id") % 11 != 0, F.concat(F.upper(F.substring("event_type", 1, 2)), F.lit("-"), F.col("pdf_page").cast("string")))
    return e.select(F.col("user_id").alias("document_id"), "pdf_page", label.alias("printed_page"))


def label_runs(spark, sf_dir):
    out = pages.reconcile_labels(labelled(spark, sf_dir), min_run=14)
    return out.select("document_id", F.col("pdf_page").cast("long").alias("pdf_page"), "series", "label_source")


def label_gaps(spark, sf_dir):
    out = pages.label_issues(pages.reconcile_labels(labelled(spark, sf_dir), min_run=14)).where("kind = 'missing_page'")
    return out.select("document_id", "severity", F.element_at("pdf_pages", 1).cast("long").alias("first_page"), F.size("pdf_pages").cast("long").alias("n_pages"))


def cmp_argmax(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = field_rows(
        e,
        ("event_id", "scan_order"),
        document_id=F.col("user_id").cast("string"),
        field_name=F.col("event_type"),
        document_layer=F.lit("agreement-ex2.1"),
        value_num=F.col("value"),
        confidence=F.floor("value") % 5 / 5.0,
        status=F.when(F.col("event_id") % 3 == 0, "not_found").otherwise("found"),
    )
    best = compare.best_readings(rows)
    return best.select("document_id", "field_name", "base", F.col("reading.value_num").alias("value"), F.col("reading.status").alias("status"))


def reconcile(spark, sf_dir):
    """Line states of an order as readings of one field by several requests."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    rows = field_rows(li, ("l_partkey", "reading_index"), document_id=F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), field_name=F.lit("state"), document_layer=F.lit("agreement"), value_text=F.col("l_linestatus"), confidence=(F.col("l_quantity") + F.lit(50)) / 200, pdf_page=n, status=F.when(F.col("l_quantity") > 45, "unresolved").otherwise("found"), notes=F.array().cast("array<string>"))
    out = readings.reconcile(rows.withColumn("chunk_index", F.col("pdf_page")))
    return out.groupBy("status", "value_text", "review_status", F.size("notes").alias("n_notes")).agg(F.count(F.lit(1)).alias("n_orders"))


def controlled(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    name = F.when(k % 5 == 0, "company_termination_fee").when(k % 5 == 1, "matching_rights").when(k % 5 == 2, "outside_date").when(k % 5 == 3, "financing_condition").otherwise("no_such_field")
    amount = F.floor("value").cast("long").cast("string")
    raw = F.when(k % 13 == 0, " ").when(k % 5 == 0, F.concat(F.when(k % 2 == 0, "up to $").otherwise("$"), amount)).when(k % 5 == 1, F.concat(F.lit("notice  in "), amount)).when(k % 5 == 2, F.when(k % 2 == 0, F.date_format("ts", "MMMM d, yyyy")).otherwise("promptly")).otherwise(F.when(k % 2 == 0, "Yes").otherwise("perhaps"))
    quote = F.when(k % 7 != 0, F.when(k % 3 == 0, F.lit("not in the record")).otherwise(F.col("event_type")))
    rows = field_rows(e, document_id=F.col("user_id").cast("string"), field_name=name, document_layer=F.lit("agreement"), raw_value=raw, evidence=quote, pdf_page=F.when(k % 17 != 0, F.lit(1)), confidence=(k % 100) / 100.0, run_id=F.lit("r"), extraction_method=F.lit("llm"), status=F.when(k % 19 == 0, "not_applicable").otherwise("found"))
    uri = text.locator_uri(F.col("document_id"), F.col("document_layer"), F.col("pdf_page"), F.lit(None).cast("string"), text.anchor(F.col("evidence")))
    return rows.withColumn("locator_uri", uri).withColumn("page_text", F.concat(F.lit("record of "), F.coalesce("evidence", F.lit(""))))


def control_outcomes(spark, sf_dir):
    rows = controlled(spark, sf_dir)
    rows = rows.withColumn("page_text", F.when(F.col("evidence") == "not in the record", "something else").otherwise(F.col("page_text")))
    out = controls.apply_controls(rows, dims.field_registry(spark))
    return out.groupBy("field_name", "status", "review_status", "normalization_status", "evidence_verified").agg(F.count(F.lit(1)).alias("n_rows"))


def record_violations(spark, sf_dir):
    rows = controlled(spark, sf_dir).drop("page_text")
    out = controls.violations(rows, dims.field_registry(spark)).select(F.explode("violations").alias("violation"))
    return out.groupBy("violation").agg(F.count(F.lit(1)).alias("n_rows"))


def status_counts(spark, sf_dir):
    return readings.status_counts(controlled(spark, sf_dir).drop("page_text"))


def not_applicable(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    s = n.select(F.col("n_name").alias("document_id"), F.element_at(F.array(*[F.lit(x) for x in ("merger", "tender_offer", "takeover_offer", "scheme_of_arrangement", "unknown")]), (F.col("n_nationkey") % 5 + 1).cast("int")).alias("structure"))
    out = controls.not_applicable_rows(s, dims.field_registry(spark), F.lit("r"))
    return out.select("document_id", "field_name", "category", "status", "confidence")


def judged(spark, sf_dir):
    """Two layers that say quality and toxicity of a labelled document."""
    lab = table(spark, sf_dir, "labels")
    doc = F.col("doc_id").cast("string")
    side = lambda layer, v, bad: field_rows(lab, document_id=doc, field_name=F.lit("bridge_amount"), document_layer=F.lit(layer), value_num=v.cast("double"), raw_value=v.cast("string"), run_id=F.lit("r"), is_critical=F.lit(False), review_status=F.when(bad, "exception").when(F.col("doc_id") % 10 == 3, "verified").otherwise("unreviewed"))
    return side("filing-summary", F.col("quality"), F.col("doc_id") % 5 == 0).unionByName(side("agreement", F.col("toxic"), F.lit(False)))


def review_items(spark, sf_dir):
    rows = judged(spark, sf_dir)
    out = review.items(rows, compare.compare(rows))
    return out.select("document_id", "document_layer", "review_reason", F.col("conflict_with.value_num").alias("other_value"))


def review_queue(spark, sf_dir):
    return review.queue(judged(spark, sf_dir)).select("document_id", "document_layer", "status")


def corrections(spark, sf_dir):
    """A correction of every fourth summary: some refused, the rest laid over the rows."""
    rows = judged(spark, sf_dir)
    c = rows.where((F.col("document_layer") == "filing-summary") & (F.col("document_id").cast("long") % 4 == 0))
    k = F.col("document_id").cast("long")
    edits = c.select("document_id", F.when(k % 3 == 2, "no_such_field").otherwise(F.col("field_name")).alias("field_name"), "document_layer", "run_id", F.lit(1).cast("long").alias("edit_seq"), F.when(k % 12 == 0, F.lit("up to $5")).otherwise(F.lit("€7 million")).alias("raw_value"), F.lit("quote").alias("evidence"), F.lit(None).cast("string").alias("printed_page"), F.lit(1).alias("pdf_page"), F.lit(None).cast("string").alias("section"), F.lit("seen").alias("reviewer_note"))
    pages_ = rows.select("document_id").distinct().select("document_id", F.lit(1).alias("pdf_page"), F.lit("a quote here").alias("text"), F.lit("A-1").alias("printed_page"))
    judged_ = review.judge_corrections(edits, rows, dims.field_registry(spark), pages_)
    out = review.overlay(rows, judged_)
    return out.select("document_id", "document_layer", "value_num", "currency", "status", "review_status", "extraction_method", "confidence", "printed_page", "evidence_verified")


def qa_context(spark, sf_dir):
    """The whole text of each turn as a field of its conversation."""
    c = table(spark, sf_dir, "conversations")
    said = F.col("text")
    rows = field_rows(c, document_id=F.col("conv_id").cast("string"), field_name=F.concat(F.lit("turn"), F.lpad(F.col("turn").cast("string"), 3, "0")), document_layer=F.col("role"), value_text=said, raw_value=said, evidence=said, pdf_page=F.col("turn"), confidence=F.lit(0.5), status=F.when(F.col("role") == "system", "unresolved").otherwise("found"))
    return context.context(rows).select("document_id", "context", "n_fields")


def qa_gate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = field_rows(c, document_id=F.col("conv_id").cast("string"), field_name=F.lit("turn"), value_text=F.col("role"), status=F.when(F.col("conv_id") % 3 == 0, "unresolved").otherwise("found"))
    asks = c.select(F.col("conv_id").cast("string").alias("document_id")).distinct().withColumn("question", F.lit("Who speaks?"))
    return context.gate(asks, rows).select("document_id", "ask_model", "answer")


QUERIES = {f.__name__: f for f in (label_runs, label_gaps, cmp_argmax, reconcile, control_outcomes, record_violations, status_counts, not_applicable, review_items, review_queue, corrections, qa_context, qa_gate)}

_RUNS = """e AS (SELECT user_id AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pdf_page, CASE WHEN event_id % 11 <> 0 THEN upper(substr(event_type, 1, 2)) END AS series FROM events),
i AS (SELECT *, pdf_page - row_number() OVER (PARTITION BY document_id, series ORDER BY pdf_page) AS island FROM e),
r AS (SELECT document_id, pdf_page, series, CASE WHEN series IS NULL THEN 'absent' WHEN count(*) OVER (PARTITION BY document_id, series, island) >= 14 OR count(*) OVER (PARTITION BY document_id, series) >= 14 THEN 'reconciled' ELSE 'rejected' END AS label_source FROM i)"""
_CONTROLLED = """c AS (SELECT event_id AS k, user_id, CASE event_id % 5 WHEN 0 THEN 'company_termination_fee' WHEN 1 THEN 'matching_rights' WHEN 2 THEN 'outside_date' WHEN 3 THEN 'financing_condition' ELSE 'no_such_field' END AS field_name,
 (event_id % 100) / 100.0::DOUBLE AS confidence, event_id % 19 = 0 AS na, event_id % 13 = 0 AS blank, event_id % 7 = 0 AS no_quote, event_id % 17 = 0 AS no_page, event_id % 3 = 0 AS bad_quote FROM events),
n AS (SELECT *, CASE k % 5 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'ambiguous' ELSE 'ok' END WHEN 1 THEN 'ok' ELSE CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'ambiguous' END END AS norm, CASE WHEN k % 5 IN (0, 2, 3) THEN 0.75 ELSE 0.6 END AS bar, k % 5 <> 4 AND NOT na AND NOT blank AS live FROM c)"""
_JUDGED = """j AS (SELECT doc_id, doc_id::VARCHAR AS document_id, 'filing-summary' AS document_layer, quality::DOUBLE AS v, toxic::DOUBLE AS other, CASE WHEN doc_id % 5 = 0 THEN 'exception' WHEN doc_id % 10 = 3 THEN 'verified' ELSE 'unreviewed' END AS review_status FROM labels
 UNION ALL SELECT doc_id, doc_id::VARCHAR, 'agreement', toxic::DOUBLE, quality::DOUBLE, CASE WHEN doc_id % 10 = 3 THEN 'verified' ELSE 'unreviewed' END FROM labels)"""
_LIMITS = "(VALUES ('merger_subsidiary', 'Transaction identity', ['merger','tender_offer','scheme_of_arrangement']), ('offer_or_acceptance_period', 'Timing', ['tender_offer','takeover_offer']), ('shareholder_approval_threshold', 'Conditions', ['merger','scheme_of_arrangement']), ('tender_acceptance_threshold', 'Conditions', ['tender_offer','takeover_offer'])) f(field_name, category, has)"

ORACLES = {
    "label_runs": f"WITH {_RUNS} SELECT document_id, pdf_page, series, label_source FROM r",
    "label_gaps": f"WITH {_RUNS}, g AS (SELECT document_id, pdf_page, lag(pdf_page) OVER (PARTITION BY document_id, series ORDER BY pdf_page) AS prev FROM r WHERE label_source = 'reconciled') SELECT document_id, CASE WHEN pdf_page - prev = 2 THEN 'info' ELSE 'warning' END AS severity, prev + 1 AS first_page, pdf_page - prev - 1 AS n_pages FROM g WHERE pdf_page - prev > 1",
    "cmp_argmax": "SELECT user_id::VARCHAR AS document_id, event_type AS field_name, 'agreement' AS base, value, status FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'not_found' ELSE 'found' END AS status, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 = 0, floor(value) % 5 DESC, event_id) AS r FROM events) WHERE r = 1",
    "reconcile": """WITH l AS (SELECT l_orderkey AS o, (l_linenumber, l_partkey) AS n, l_linestatus AS v, l_quantity AS q, l_quantity <= 45 AS ok FROM lineitem),
a AS (SELECT o, count(DISTINCT v) FILTER (ok) AS d, count(*) FILTER (ok) AS m, min(v) FILTER (ok) AS v FROM l GROUP BY o)
SELECT CASE WHEN d > 1 THEN 'conflict' WHEN d = 1 THEN 'found' ELSE 'unresolved' END AS status, CASE WHEN d = 1 THEN v WHEN d = 0 THEN w END AS value_text, CASE WHEN d > 1 THEN 'exception' ELSE 'unreviewed' END AS review_status, (CASE WHEN d > 1 THEN d + 1 WHEN m > 1 THEN 1 ELSE 0 END)::INT AS n_notes, count(*) AS n_orders
FROM a LEFT JOIN (SELECT o, arg_min(v, n) AS w FROM l WHERE NOT ok GROUP BY o) USING (o) GROUP BY 1, 2, 3, 4""",
    "control_outcomes": f"""WITH {_CONTROLLED}, e AS (SELECT *, norm = 'ok' AND NOT no_quote AND NOT no_page AND NOT bad_quote AND confidence >= bar AS good FROM n)
SELECT field_name, CASE WHEN k % 5 = 4 THEN 'unresolved' WHEN na THEN 'not_applicable' WHEN blank THEN 'not_found' WHEN good THEN 'found' ELSE 'unresolved' END AS status, CASE WHEN k % 5 = 4 OR (live AND NOT good) THEN 'exception' ELSE 'unreviewed' END AS review_status,
CASE WHEN live THEN norm END AS normalization_status, CASE WHEN live THEN NOT no_quote AND NOT no_page AND NOT bad_quote END AS evidence_verified, count(*) AS n_rows FROM e GROUP BY ALL""",
    "record_violations": f"""WITH {_CONTROLLED}, v AS (SELECT unnest(list_filter([CASE WHEN k % 5 = 4 THEN 'unknown field_name' END, CASE WHEN NOT na THEN 'found without a value' END, CASE WHEN NOT na AND no_quote THEN 'found without evidence' END, CASE WHEN NOT na AND no_page THEN 'found without a page' END], lambda x: x IS NOT NULL)) AS violation FROM n) SELECT violation, count(*) AS n_rows FROM v GROUP BY 1""",
    "status_counts": "SELECT user_id::VARCHAR AS document_id, CASE WHEN event_id % 19 = 0 THEN 'not_applicable' ELSE 'found' END AS status, count(*) AS n_fields FROM events GROUP BY 1, 2",
    "not_applicable": f"WITH s AS (SELECT n_name AS document_id, ['merger','tender_offer','takeover_offer','scheme_of_arrangement','unknown'][n_nationkey % 5 + 1] AS structure FROM nation) SELECT document_id, field_name, category, 'not_applicable' AS status, 1.0::DOUBLE AS confidence FROM s, {_LIMITS} WHERE structure <> 'unknown' AND NOT list_contains(has, structure)",
    "review_items": f"WITH {_JUDGED} SELECT document_id, document_layer, CASE WHEN v <> other AND review_status <> 'verified' THEN 'layer_conflict' ELSE 'control_exception' END AS review_reason, CASE WHEN v <> other THEN other END AS other_value FROM j WHERE (v <> other AND review_status <> 'verified') OR review_status = 'exception'",
    "review_queue": f"WITH {_JUDGED} SELECT document_id, document_layer, 'found' AS status FROM j WHERE review_status = 'exception'",
    "corrections": f"""WITH {_JUDGED}, c AS (SELECT *, document_layer = 'filing-summary' AND doc_id % 4 = 0 AND doc_id % 3 <> 2 AND doc_id % 12 <> 0 AS done FROM j)
SELECT document_id, document_layer, CASE WHEN done THEN 7e6::DOUBLE ELSE v END AS value_num, CASE WHEN done THEN 'EUR' END AS currency, 'found' AS status, CASE WHEN done THEN 'verified' ELSE review_status END AS review_status, CASE WHEN done THEN 'hybrid' END AS extraction_method,
CASE WHEN done THEN 1.0::DOUBLE ELSE 0.9 END AS confidence, CASE WHEN done THEN 'A-1' END AS printed_page, CASE WHEN done THEN true END AS evidence_verified FROM c""",
    "qa_context": f"""WITH r AS (SELECT conv_id, turn, role, replace(replace(text, '{context.CLOSE}', 'fields> > >'), chr(10), ' ') AS s FROM conversations WHERE role <> 'system' AND text IS NOT NULL)
SELECT conv_id::VARCHAR AS document_id, '{context.OPEN}' || chr(10) || string_agg('turn' || lpad(turn::VARCHAR, 3, '0') || ': ' || s || ' | layer ' || role || ' | page ' || turn || ' | confidence 0.50 | "' || s || '"', chr(10) ORDER BY turn, role) || chr(10) || '{context.CLOSE}' AS context, count(*) AS n_fields FROM r GROUP BY 1""",
    "qa_gate": f"SELECT DISTINCT conv_id::VARCHAR AS document_id, conv_id % 3 <> 0 AS ask_model, CASE WHEN conv_id % 3 = 0 THEN '{context.NOTHING}' END AS answer FROM conversations",
}
