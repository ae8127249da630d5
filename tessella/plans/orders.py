"""Normalizers, comparison, timeline and pricing on orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions import clauses, normalize
from tessella.operators import compare, pricing, timeline
from tessella.sources import store
from tessella.sources.tables import table


def field_rows(df: DataFrame, *more: tuple[str, str], **columns) -> DataFrame:
    """Rows of ``extracted_fields``; columns that are not given are null. ``more``
    names columns of ``df`` to carry along, with their new names."""
    kinds = dict(x.strip().split(" ", 1) for x in schemas.EXTRACTED_FIELDS.split(", "))
    given = {"status": F.lit("found"), "confidence": F.lit(0.9), "review_status": F.lit("unreviewed")} | columns
    return df.select(*[(given[c] if c in given else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], *[F.col(a).alias(b) for a, b in more])


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))


def _dollars(cents):
    return F.concat((cents / F.lit(100)).cast("decimal(18,2)").cast("string"))


def money_scan(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.concat(F.when(k % 5 == 0, "up to $").when(k % 5 == 1, "about USD ").otherwise("pays $"), _dollars(F.col("cents")), F.when(k % 4 == 0, " million in cash").when(k % 4 == 1, "bn").otherwise(" at closing"))
    d = priced(spark, sf_dir).select(k.alias("o_orderkey"), said.alias("said"))
    d = d.select("o_orderkey", normalize.money(F.col("said")).alias("m"), normalize.embedded_amounts(F.col("said")).alias("a"))
    return d.select("o_orderkey", F.col("m.value_num").alias("value_num"), "m.status", "m.qualifier", F.size("a").cast("long").alias("n_amounts"), F.get("a", F.lit(0)).alias("amount"))


def date_norm(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    said = (
        F.when(k % 6 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k % 6 == 1, F.date_format(d, "MMMM d, yyyy"))
        .when(k % 6 == 2, F.date_format(d, "d MMM yyyy"))
        .when(k % 6 == 3, F.concat(F.lit("dated as of "), F.date_format(d, "MMMM d, yyyy"), F.lit(" among the parties")))
        .when(k % 6 == 4, F.concat(F.lit("ten days after "), F.date_format(d, "MM/dd/yyyy")))
        .otherwise(F.lit("some day"))
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", normalize.date(said).alias("n"))
    return o.select("o_orderkey", F.col("n.value_text").alias("iso_date"), "n.status")


def enum_norm(spark, sf_dir):
    allowed = F.array(*[F.lit(x) for x in ("1_urgent", "2_high", "3_medium", "5_low")])
    said = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.replace("o_orderpriority", F.lit("-"), F.lit(" - ")))
    o = table(spark, sf_dir, "orders").select(normalize.enum(said, allowed).alias("n"))
    return o.groupBy(F.col("n.value_text").alias("priority"), F.col("n.status").alias("status")).agg(F.count(F.lit(1)).alias("n_orders"))


def tenor_norm(spark, sf_dir):
    k = F.col("o_orderkey")
    n = (k % 40 + 1).cast("string")
    said = F.when(k % 4 == 0, F.concat(n, F.lit(" days after closing"))).when(k % 4 == 1, F.concat(F.lit("a "), n, F.lit("-month facility"))).when(k % 4 == 2, F.concat(n, F.lit(" years"))).otherwise("on demand")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(clauses.tenor_years(said), 9).alias("years"))


def two_sources(spark, sf_dir):
    """Summary rows as they are, agreement rows edited by key: every class occurs."""
    o = priced(spark, sf_dir)
    k, cents = F.col("o_orderkey"), F.col("cents")
    doc = F.concat(F.lit("o"), (k % 97).cast("string"))
    name = F.concat(F.lit("total_"), k.cast("string"))
    raw = F.concat(F.lit("$"), _dollars(cents))
    base = {"document_id": doc, "field_name": name, "evidence": raw, "pdf_page": F.lit(1)}
    summary = field_rows(o, **base, document_layer=F.lit("filing-summary"), value_num=F.when(k % 7 != 5, cents / F.lit(100.0)), raw_value=F.when(k % 7 != 5, raw), currency=F.lit("USD"), status=F.when(k % 7 == 5, "not_found").when(k % 14 == 6, "not_applicable").otherwise("found"))
    other = F.when(k % 7 == 2, cents + 100).otherwise(cents) / F.lit(100.0)
    agreement = field_rows(
        o.where(k % 7 != 4),
        **base,
        document_layer=F.lit("agreement-ex2.1"),
        value_num=F.when(k % 14 != 13, other),
        raw_value=F.when(k % 7 == 1, F.concat(F.lit("USD "), _dollars(cents))).when(k % 7 == 2, F.lit("$?")).otherwise(raw),
        currency=F.when(k % 7 == 3, "EUR").otherwise("USD"),
        status=F.when(k % 14 == 13, "unresolved").otherwise("found"),
    )
    return summary.unionByName(agreement)


def cmp_two_source(spark, sf_dir):
    c = compare.compare(two_sources(spark, sf_dir))
    return c.select("document_id", "field_name", "classification", F.col("preferred.value_num").alias("preferred_value"), F.col("preferred.document_layer").alias("preferred_layer"), "needs_review")


def cmp_class_counts(spark, sf_dir):
    return compare.class_counts(compare.compare(two_sources(spark, sf_dir)))


def cmp_text(spark, sf_dir):
    """Text readings: names in other case, short forms, prose with and without amounts."""
    c = table(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.col("c_name")
    other = (
        F.when(k % 6 == 0, F.upper(name)).when(k % 6 == 1, F.concat(name, F.lit(" Corporation"))).when(k % 6 == 2, F.lit("Someone Else"))
        .when(k % 6 == 3, F.concat(F.lit("a fee of $"), k.cast("string"), F.lit(" million"))).when(k % 6 == 4, F.concat(F.lit("a fee of EUR "), (k + 1).cast("string"))).otherwise(F.repeat(F.lit("long prose "), 9))
    )
    mine = F.when(k % 6 == 3, F.concat(F.lit("the fee is USD "), k.cast("string"), F.lit(",000,000 in cash"))).when(k % 6 == 4, F.concat(F.lit("the fee is $"), k.cast("string"))).otherwise(name)
    base = {"document_id": name, "field_name": F.lit("target")}
    rows = field_rows(c, **base, document_layer=F.lit("filing-summary"), value_text=mine, raw_value=mine).unionByName(field_rows(c, **base, document_layer=F.lit("agreement"), value_text=other, raw_value=other))
    return compare.compare(rows).select("document_id", "classification", "is_critical", "category")


def export_records(spark, sf_dir):
    out = store.export_records(two_sources(spark, sf_dir))
    return out.select("document_id", "field_name", "document_layer", "normalized_value", "page", "status", "currency")


def deal_rows(spark, sf_dir):
    """A signing date, an outside date and an extension clause for each order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    doc = F.concat(F.lit("o"), k.cast("string"))
    signed, outside = F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 365)
    clause = F.when(k % 5 == 0, "two successive periods of ninety (90) days").when(k % 5 == 1, "may be extended by three (3) months at the option of either party").when(k % 5 == 2, "shall be extended automatically twice by 10 business days").when(k % 5 == 3, "as the parties agree")
    as_rows = lambda f, v, **more: field_rows(o, document_id=doc, field_name=F.lit(f), document_layer=F.lit("agreement"), value_text=v, raw_value=v, pdf_page=F.lit(9), printed_page=F.lit("A-9"), **more)
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return as_rows("agreement_date", iso(signed)).unionByName(as_rows("outside_date", iso(outside))).unionByName(as_rows("extension_conditions", clause, status=F.when(k % 5 == 4, "not_found").otherwise("found")))


def timeline_ext(spark, sf_dir):
    t = timeline.build(compare.compare(deal_rows(spark, sf_dir)))
    return timeline.calculated(t).select("document_id", "event", F.date_format("resolved_date", "yyyy-MM-dd").alias("resolved_date"), "derivation", "kind", "page")


def timeline_horizon(spark, sf_dir):
    c = compare.compare(deal_rows(spark, sf_dir))
    h = timeline.horizon(c)
    return h.select("document_id", "base_days", "extension_days", "total_days", F.date_format("final_outside_date", "yyyy-MM-dd").alias("final_date"), "extension_kind", F.size("extension_dates").alias("n_dates"), F.col("outstanding_conditions").cast("long").alias("outstanding"), "is_complete")


def segments(spark, sf_dir):
    """Market segments as deals: a bridge in cents of their balances, some in EUR."""
    c = table(spark, sf_dir, "customer")
    per = c.groupBy(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("document_id"), "c_nationkey").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    k = F.col("c_nationkey")
    as_rows = lambda f, cond, **v: field_rows(per.where(cond), document_id=F.col("document_id"), field_name=F.lit(f), document_layer=F.lit("credit-agreement-ex10.1"), **v)
    rows = as_rows("bridge_amount", (k % 2 == 0) & (F.col("cents") > 0), value_num=F.col("cents") * 1000.0, raw_value=F.lit("x"))
    rows = rows.unionByName(as_rows("bridge_currency", k % 3 == 0, value_text=F.lit("EUR"), raw_value=F.lit("EUR")))
    rows = rows.unionByName(as_rows("bridge_maturity", k % 4 == 0, value_text=F.lit("364 days after the Closing Date"), raw_value=F.lit("364 days")))
    dates = F.when(k % 3 == 0, F.array(F.lit("2027-09-23"), F.lit("2027-12-22"))).when(k % 3 == 1, F.array(F.lit("2027-09-23"))).otherwise(F.array())
    horizons = per.select("document_id", F.to_date(F.lit("2027-06-25")).alias("outside_date"), F.transform(dates.cast("array<string>"), lambda d: F.to_date(d)).alias("extension_dates"))
    return horizons, rows


def _inputs(spark, sf_dir):
    horizons, rows = segments(spark, sf_dir)
    return horizons, pricing.financing(horizons, pricing.found_values(rows, compare.compare(rows)))


def financing_inputs(spark, sf_dir):
    _, inputs = _inputs(spark, sf_dir)
    return inputs.select("document_id", "notional", "notional_source", "currency", "currency_source", "tenor_years", "tenor_source", F.round("dv01", 4).alias("dv01"), "has_fx_exposure")


def scenario_grid(spark, sf_dir):
    horizons, inputs = _inputs(spark, sf_dir)
    return pricing.run(horizons, inputs).select("document_id", "scenario_id", "strategy", "risk", F.round("pnl", 2).alias("pnl"))


def expected_pnl(spark, sf_dir):
    horizons, inputs = _inputs(spark, sf_dir)
    return pricing.expected(pricing.net(pricing.run(horizons, inputs))).select("document_id", "strategy", F.round("expected_pnl", 0).alias("expected_pnl"))


def risk_exposures(spark, sf_dir):
    _, inputs = _inputs(spark, sf_dir)
    return pricing.exposures(inputs).select("document_id", "strategy", "benchmark_rate", "swap_spread", "issuer_credit_spread", "fx")


def scope_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), "c_name")
    a = o.where(F.col("o_orderstatus") == "F").select(F.col("o_orderpriority").alias("document_id"), F.col("o_custkey").alias("run_id"))
    b = o.where(F.col("o_orderstatus") == "P").select(F.col("o_orderpriority").alias("document_id"), F.col("o_custkey").alias("run_id"))
    docs = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "document_id string")
    return store.scoped_runs(runs, docs, a, b)


QUERIES = {f.__name__: f for f in (money_scan, date_norm, enum_norm, tenor_norm, cmp_two_source, cmp_class_counts, cmp_text, export_records, timeline_ext, timeline_horizon, financing_inputs, scenario_grid, expected_pnl, risk_exposures, scope_runs)}

_PRICED = "o AS (SELECT *, o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS cents FROM orders)"
_CLASS = """cmp AS (SELECT 'o' || (k % 97) AS document_id, 'total_' || k AS field_name, CASE WHEN k % 14 = 6 THEN 'not_applicable' WHEN k % 7 = 4 THEN 'summary_only' WHEN k % 7 = 5 THEN 'agreement_only' WHEN k % 14 = 13 THEN 'summary_only'
 WHEN k % 7 = 3 THEN 'conflict' WHEN k % 7 = 2 THEN 'conflict' WHEN k % 7 = 1 THEN 'normalized_match' ELSE 'match' END AS classification, k, cents FROM o)"""
_SEGMENTS = """s AS (SELECT c_mktsegment || '/' || c_nationkey AS document_id, c_nationkey AS k, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents FROM customer GROUP BY 1, 2),
i AS (SELECT *, CASE WHEN k % 2 = 0 AND cents > 0 THEN cents * 1000.0::DOUBLE ELSE 4e9::DOUBLE END AS notional, CASE WHEN k % 4 = 0 THEN round_even(364 / 365.0::DOUBLE, 3) ELSE 7.0::DOUBLE END AS tenor FROM s),
v AS (SELECT *, notional / 1e8::DOUBLE * 65000.0::DOUBLE * (tenor / 7.0::DOUBLE) AS dv01 FROM i)"""
_GRID = """sc(scenario_id, rate, credit, fails) AS (VALUES ('rates_up_25', 25.0::DOUBLE, 0.0::DOUBLE, false), ('rates_down_25', -25.0, 0.0, false), ('rates_up_50', 50.0, 0.0, false), ('rates_and_credit', 25.0, 20.0, false), ('delay_first_extension', 0.0, 0.0, false), ('delay_final_extension', 0.0, 0.0, false), ('transaction_failure', 0.0, 0.0, true)),
st(strategy) AS (VALUES ('Unhedged'), ('Forward-starting IRS'), ('Deal-contingent hedge')),
g AS (SELECT *, CASE WHEN scenario_id = 'delay_first_extension' AND k % 3 < 2 THEN 90 WHEN scenario_id = 'delay_final_extension' AND k % 3 = 0 THEN 180 END AS days, CASE WHEN scenario_id LIKE 'delay%' THEN CASE WHEN k % 3 = 1 THEN 0.1::DOUBLE ELSE 0.05 END WHEN fails THEN 0.05 END AS p FROM v, sc, st WHERE NOT (scenario_id = 'delay_final_extension' AND k % 3 = 1)),
x AS (SELECT *, scenario_id LIKE 'delay%' AND days IS NULL AS undated FROM g),
z AS (SELECT document_id, scenario_id, strategy, p, unnest([
 {'risk': 'benchmark_rate', 'pnl': CASE WHEN undated OR fails OR strategy <> 'Unhedged' THEN 0.0::DOUBLE ELSE -dv01 * rate + 0.0 END}, {'risk': 'swap_spread', 'pnl': 0.0::DOUBLE},
 {'risk': 'issuer_credit_spread', 'pnl': CASE WHEN undated OR fails THEN 0.0::DOUBLE ELSE -dv01 * credit + 0.0 END}, {'risk': 'fx', 'pnl': 0.0::DOUBLE},
 {'risk': 'timing', 'pnl': CASE WHEN strategy = 'Forward-starting IRS' AND days > 0 THEN -(notional * (0.044::DOUBLE - 0.0425::DOUBLE) * (days / 365.0::DOUBLE)) ELSE 0.0 END},
 {'risk': 'transaction_completion', 'pnl': CASE WHEN strategy = 'Deal-contingent hedge' AND NOT undated THEN -dv01 * 15.0::DOUBLE ELSE 0.0 END},
 {'risk': 'hedge_unwind', 'pnl': CASE WHEN fails AND strategy = 'Forward-starting IRS' THEN -dv01 * 2.0::DOUBLE ELSE 0.0 END}]) AS r FROM x)"""
_CLAUSE = """d AS (SELECT 'o' || o_orderkey AS document_id, o_orderkey AS k, o_orderdate::DATE AS signed, o_orderdate::DATE + 365 AS outside, CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS n, CASE o_orderkey % 5 WHEN 0 THEN 90 WHEN 1 THEN 90 WHEN 2 THEN 10 END AS step,
 CASE o_orderkey % 5 WHEN 0 THEN '90 days' WHEN 1 THEN '3 months' WHEN 2 THEN '10 business days' END AS unit, CASE o_orderkey % 5 WHEN 2 THEN 'automatically_extended' ELSE 'party_election' END AS kind FROM orders)"""

ORACLES = {
    "money_scan": f"""WITH {_PRICED}, a AS (SELECT k, cents / 100.0::DOUBLE * CASE k % 4 WHEN 0 THEN 1e6 WHEN 1 THEN 1e9 ELSE 1 END AS v FROM o)
SELECT k AS o_orderkey, v AS value_num, CASE WHEN k % 5 = 0 THEN 'ambiguous' ELSE 'ok' END AS status, CASE k % 5 WHEN 0 THEN 'up to' WHEN 1 THEN 'about' END AS qualifier, 1::BIGINT AS n_amounts, v AS amount FROM a""",
    "date_norm": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso_date, CASE WHEN o_orderkey % 6 < 4 THEN 'ok' WHEN o_orderkey % 6 = 4 THEN 'ambiguous' ELSE 'unparseable' END AS status FROM orders",
    "enum_norm": "SELECT CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE lower(replace(o_orderpriority, '-', '_')) END AS priority, CASE WHEN o_orderpriority LIKE '4%' THEN 'ambiguous' ELSE 'ok' END AS status, count(*) AS n_orders FROM orders GROUP BY 1, 2",
    "tenor_norm": "SELECT o_orderkey, round((o_orderkey % 40 + 1) * CASE o_orderkey % 4 WHEN 0 THEN 1 / 365.0::DOUBLE WHEN 1 THEN 1 / 12.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE END, 9) AS years FROM orders",
    "cmp_two_source": f"""WITH {_PRICED}, {_CLASS} SELECT document_id, field_name, classification, CASE WHEN classification = 'not_applicable' THEN NULL WHEN k % 7 = 2 THEN (cents + 100) / 100.0::DOUBLE ELSE cents / 100.0::DOUBLE END AS preferred_value,
CASE classification WHEN 'not_applicable' THEN NULL WHEN 'summary_only' THEN 'filing-summary' ELSE 'agreement-ex2.1' END AS preferred_layer, classification = 'conflict' AS needs_review FROM cmp""",
    "cmp_class_counts": f"WITH {_PRICED}, {_CLASS} SELECT document_id, classification, count(*) AS n_fields FROM cmp GROUP BY 1, 2",
    "cmp_text": "SELECT c_name AS document_id, CASE WHEN c_custkey % 6 IN (0, 1, 3, 5) THEN 'normalized_match' ELSE 'conflict' END AS classification, true AS is_critical, 'Transaction identity' AS category FROM customer",
    "export_records": f"""WITH {_PRICED}, r AS (SELECT k, cents, 'filing-summary' AS document_layer, CASE WHEN k % 7 <> 5 THEN cents END AS v, CASE WHEN k % 7 = 5 THEN 'not_found' WHEN k % 14 = 6 THEN 'not_applicable' ELSE 'found' END AS status, 'USD' AS currency FROM o
 UNION ALL SELECT k, cents, 'agreement-ex2.1', CASE WHEN k % 14 <> 13 THEN CASE WHEN k % 7 = 2 THEN cents + 100 ELSE cents END END, CASE WHEN k % 14 = 13 THEN 'unresolved' ELSE 'found' END, CASE WHEN k % 7 = 3 THEN 'EUR' ELSE 'USD' END FROM o WHERE k % 7 <> 4)
SELECT 'o' || (k % 97) AS document_id, 'total_' || k AS field_name, document_layer, (v // 100) || '.' || CASE WHEN v % 100 = 0 THEN '0' WHEN v % 10 = 0 THEN ((v % 100) // 10)::VARCHAR ELSE lpad((v % 100)::VARCHAR, 2, '0') END AS normalized_value, '1' AS page, status, currency FROM r""",
    "timeline_ext": f"""WITH {_CLAUSE}, e AS (SELECT *, unnest(generate_series(1, n)) AS i FROM d WHERE n IS NOT NULL)
SELECT document_id, 'Outside date, extension ' || i || ' of ' || n AS event, strftime(outside + (i * step)::INT, '%Y-%m-%d') AS resolved_date, strftime(outside, '%Y-%m-%d') || ' + ' || i || ' x ' || unit || CASE WHEN unit = '3 months' THEN ' (months counted as 30 days)' ELSE '' END AS derivation, kind, 'A-9' AS page FROM e""",
    "timeline_horizon": f"""WITH {_CLAUSE} SELECT document_id, 365 AS base_days, (n * step)::INT AS extension_days, (365 + coalesce(n * step, 0))::INT AS total_days, strftime(outside + (n * step)::INT, '%Y-%m-%d') AS final_date,
CASE WHEN k % 5 < 4 THEN kind END AS extension_kind, coalesce(n, 0)::INT AS n_dates, 0::BIGINT AS outstanding, true AS is_complete FROM d""",
    "financing_inputs": f"""WITH {_SEGMENTS} SELECT document_id, notional, CASE WHEN k % 2 = 0 AND cents > 0 THEN 'extracted' ELSE 'assumed' END AS notional_source, CASE WHEN k % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN k % 3 = 0 THEN 'extracted' ELSE 'assumed' END AS currency_source,
tenor AS tenor_years, CASE WHEN k % 4 = 0 THEN 'extracted' ELSE 'assumed' END AS tenor_source, round(dv01, 4) AS dv01, k % 3 = 0 AS has_fx_exposure FROM v""",
    "scenario_grid": f"WITH {_SEGMENTS}, {_GRID} SELECT document_id, scenario_id, strategy, r.risk AS risk, round(r.pnl, 2) AS pnl FROM z",
    "expected_pnl": f"WITH {_SEGMENTS}, {_GRID}, n AS (SELECT document_id, scenario_id, strategy, p, sum(r.pnl) AS net FROM z GROUP BY ALL) SELECT document_id, strategy, round(coalesce(sum(net * p), 0.0), 0) AS expected_pnl FROM n GROUP BY 1, 2",
    "risk_exposures": f"""WITH {_SEGMENTS}, st(strategy) AS (VALUES ('Unhedged'), ('Forward-starting IRS'), ('Deal-contingent hedge')) SELECT document_id, strategy, CASE WHEN strategy = 'Unhedged' THEN -2600000.0::DOUBLE ELSE 0.0 END AS benchmark_rate, CASE WHEN strategy = 'Unhedged' THEN 0.0::DOUBLE ELSE -2600000.0 END AS swap_spread,
-2600000.0::DOUBLE AS issuer_credit_spread, CASE WHEN k % 3 = 0 THEN 'exposed, not priced: EUR' ELSE 'none' END AS fx FROM v, st""",
    "scope_runs": "SELECT c_custkey AS run_id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))",
}
