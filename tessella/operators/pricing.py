"""Scenario by strategy by risk pricing of a financing, for all documents at once.

The scenario and strategy tables are fixed and tiny. Results are long:
one row per document, scenario, strategy and risk.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import dims
from tessella.functions.clauses import tenor_years

EXTRACTED, ASSUMED, DERIVED = "extracted", "assumed", "derived"


def dv01(notional: Column, per_100mm: Column | float) -> Column:
    return notional / 1e8 * per_100mm


def rate_pnl(value: Column, bps: Column) -> Column:
    """P&L of a rate move; never a negative zero."""
    return -value * bps + F.lit(0.0)


def carry_cost(notional: Column, swap: float, treasury: float, days: Column) -> Column:
    return notional * (swap - treasury) * (days / F.lit(365.0))


def found_values(rows: DataFrame, compared: DataFrame) -> DataFrame:
    """Governing value of each financing field, else its first asserted reading."""
    names = ("bridge_amount", "bridge_currency", "consideration_currency", "bridge_maturity", "interest_basis", "total_transaction_value")
    order = F.struct(F.col("document_layer"), F.col("scan_order").cast("long") if "scan_order" in rows.columns else F.lit(0).cast("long"))
    value = lambda r: F.struct(F.col(f"{r}value_num").alias("n"), F.col(f"{r}value_text").alias("t"))
    asserted = (F.col("status") == "found") & (F.col("value_num").isNotNull() | F.col("value_text").isNotNull())
    first = rows.where(asserted & F.col("field_name").isin(*names)).groupBy("document_id", "field_name").agg(F.min_by(value(""), order).alias("first"))
    governing = compared.where(F.col("field_name").isin(*names) & F.col("preferred").isNotNull()).select("document_id", "field_name", value("preferred.").alias("preferred"))
    both = first.join(governing, ["document_id", "field_name"], "full").select("document_id", "field_name", F.coalesce("preferred", "first").alias("v"))
    one = lambda f, part: F.max(F.when(F.col("field_name") == f, F.col(f"v.{part}"))).alias(f)
    return both.groupBy("document_id").agg(one("bridge_amount", "n"), one("bridge_currency", "t"), one("consideration_currency", "t"), one("bridge_maturity", "t"), one("interest_basis", "t"))


def financing(documents: DataFrame, values: DataFrame, a: Mapping = dims.ASSUMPTIONS) -> DataFrame:
    """What is priced for each document: the filing's value before the assumption,
    with source and basis of each input. DV01 scales with the tenor."""
    rows = documents.select("document_id").distinct().join(values, "document_id", "left")
    tenor = F.bround(tenor_years(F.col("bridge_maturity")), 3)
    currency = F.coalesce("bridge_currency", "consideration_currency")
    source = lambda c: F.when(c.isNotNull(), EXTRACTED).otherwise(ASSUMED)
    out = rows.select(
        "document_id",
        F.coalesce("bridge_amount", F.lit(a["notional"])).alias("notional"),
        source(F.col("bridge_amount")).alias("notional_source"),
        F.coalesce(currency, F.lit(a["currency"])).alias("currency"),
        source(currency).alias("currency_source"),
        F.coalesce(tenor, F.lit(a["tenor_years"])).alias("tenor_years"),
        source(tenor).alias("tenor_source"),
        F.coalesce("interest_basis", F.lit(a["rate_basis"])).alias("rate_basis"),
        source(F.col("interest_basis")).alias("rate_basis_source"),
        "bridge_currency",
        "consideration_currency",
    )
    scaled = dv01(F.col("notional"), a["dv01_per_100mm"]) * (F.col("tenor_years") / a["tenor_years"])
    foreign = F.array_sort(F.array_distinct(F.filter(F.array("bridge_currency", "consideration_currency"), lambda c: c.isNotNull() & (c != a["currency"]))))
    basis = F.concat(F.col("notional_source"), F.lit(" notional, scaled by tenor "), F.col("tenor_years").cast("string"), F.lit(f"/{a['tenor_years']:g}"))
    return out.withColumns({"dv01": scaled, "dv01_source": F.lit(DERIVED), "dv01_basis": basis, "foreign_currencies": foreign, "has_fx_exposure": F.size(foreign) > 0}).drop("bridge_currency", "consideration_currency")


def scenarios(horizons: DataFrame, a: Mapping = dims.ASSUMPTIONS) -> DataFrame:
    """Scenarios of each document; delays come from its extension dates.

    One date gives one delay scenario, which then has the whole probability of a
    delay; without dates both are listed, undated.
    """
    shock = lambda i, n, r, c=0.0: F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(float(r)).alias("rate"), F.lit(float(c)).alias("credit"), F.lit(None).cast("int").alias("days"), F.lit(None).cast("date").alias("to"), F.lit(None).cast("double").alias("p"), F.lit(False).alias("fails"))
    dates = F.col("extension_dates")
    dated = F.col("outside_date").isNotNull() & (F.size(F.coalesce(dates, F.array().cast("array<date>"))) > 0)
    two = ~dated | (F.size(dates) > 1)
    p = F.when(two, a["delay_probability"] / 2).otherwise(a["delay_probability"])

    def delay(which: str, when: Column) -> Column:
        to = F.when(dated, when)
        return F.struct(
            F.lit(f"delay_{which}_extension").alias("id"), F.lit(f"Closing delayed to {which} extension date").alias("name"), F.lit(0.0).alias("rate"), F.lit(0.0).alias("credit"),
            F.date_diff(to, F.col("outside_date")).alias("days"), to.alias("to"), p.alias("p"), F.lit(False).alias("fails"),
        )

    failed = F.struct(F.lit("transaction_failure").alias("id"), F.lit("Transaction failure").alias("name"), F.lit(0.0).alias("rate"), F.lit(0.0).alias("credit"), F.lit(None).cast("int").alias("days"), F.lit(None).cast("date").alias("to"), F.lit(a["failure_probability"]).alias("p"), F.lit(True).alias("fails"))
    every = F.array(
        shock("rates_up_25", "Rates +25bp", 25), shock("rates_down_25", "Rates -25bp", -25), shock("rates_up_50", "Rates +50bp", 50),
        shock("rates_and_credit", f"Rates +{a['parallel_move_bps']:.0f}bp and credit +{a['credit_move_bps']:.0f}bp", a["parallel_move_bps"], a["credit_move_bps"]),
        delay("first", F.element_at(dates, 1)), F.when(two, delay("final", F.element_at(dates, -1))), failed,
    )
    return horizons.select("document_id", F.posexplode(F.array_compact(every)).alias("ordinal", "s")).select(
        "document_id", "ordinal", F.col("s.id").alias("scenario_id"), F.col("s.name").alias("scenario"), F.col("s.rate").alias("rate_bps"), F.col("s.credit").alias("credit_bps"),
        F.lit(0.0).alias("swap_spread_bps"), F.col("s.days").alias("delay_days"), F.col("s.to").alias("delayed_to"), F.col("s.p").alias("probability"), F.col("s.fails").alias("fails"),
    )


def attribute(priced: DataFrame, a: Mapping = dims.ASSUMPTIONS) -> DataFrame:
    """P&L by risk for each scenario and strategy; an undated delay has none at all."""
    strategies = F.array(*[F.lit(s) for s in dims.STRATEGIES])
    rows = priced.withColumn("strategy", F.explode(strategies))
    live, hedged = ~F.col("fails"), F.col("strategy") != dims.STRATEGIES[0]
    forward, contingent = F.col("strategy") == dims.STRATEGIES[1], F.col("strategy") == dims.STRATEGIES[2]
    v, zero = F.col("dv01"), F.lit(0.0)
    undated = F.col("scenario_id").startswith("delay_") & F.col("delay_days").isNull()
    risk = {
        "benchmark_rate": F.when(live & ~hedged, rate_pnl(v, F.col("rate_bps"))),
        "swap_spread": F.when(live & hedged, rate_pnl(v * a["swap_spread_dv01_ratio"], F.col("swap_spread_bps"))),
        "issuer_credit_spread": F.when(live, rate_pnl(v * a["credit_dv01_ratio"], F.col("credit_bps"))),
        "fx": zero,
        "timing": F.when(live & forward & (F.coalesce("delay_days", F.lit(0)) > 0), -carry_cost(F.col("notional"), a["swap_rate"], a["treasury_rate"], F.col("delay_days"))),
        "transaction_completion": F.when(contingent, -v * a["premium_bps"]),
        "hedge_unwind": F.when(F.col("fails") & forward, -v * a["bid_offer_bps"]),
    }
    items = F.array(*[F.struct(F.lit(r).alias("risk"), F.when(undated, zero).otherwise(F.coalesce(risk[r], zero)).alias("pnl")) for r in dims.RISKS])
    out = rows.withColumn("_i", F.explode(items))
    return out.select(*[c for c in rows.columns], F.col("_i.risk").alias("risk"), F.col("_i.pnl").alias("pnl"))


def run(horizons: DataFrame, inputs: DataFrame, a: Mapping = dims.ASSUMPTIONS) -> DataFrame:
    """Long result: document, scenario, strategy, risk, pnl."""
    return attribute(scenarios(horizons, a).join(inputs, "document_id"), a)


def net(attributed: DataFrame) -> DataFrame:
    """Net P&L per document, scenario and strategy."""
    return attributed.groupBy("document_id", "ordinal", "scenario_id", "scenario", "strategy", "probability", "delay_days", "delayed_to", "currency").agg(F.sum("pnl").alias("net_pnl"))


def expected(netted: DataFrame) -> DataFrame:
    """Expected P&L per document and strategy over scenarios with a probability."""
    return netted.groupBy("document_id", "strategy").agg(F.coalesce(F.sum(F.col("net_pnl") * F.col("probability")), F.lit(0.0)).alias("expected_pnl"))


def exposures(inputs: DataFrame, a: Mapping = dims.ASSUMPTIONS, assumed_notional: bool = True) -> DataFrame:
    """Sensitivity per basis point of each strategy; what is not priced is text.

    By default on the assumed notional; else on each document's resolved DV01.
    """
    rows = inputs.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in dims.STRATEGIES])))
    v = dv01(F.lit(a["notional"]), a["dv01_per_100mm"]) if assumed_notional else F.col("dv01")
    hedged, forward, contingent = F.col("strategy") != dims.STRATEGIES[0], F.col("strategy") == dims.STRATEGIES[1], F.col("strategy") == dims.STRATEGIES[2]
    return rows.select(
        "document_id", "strategy",
        F.when(hedged, 0.0).otherwise(-v).alias("benchmark_rate"),
        F.when(hedged, -v * a["swap_spread_dv01_ratio"]).otherwise(0.0).alias("swap_spread"),
        (-v * a["credit_dv01_ratio"]).alias("issuer_credit_spread"),
        F.when(F.col("has_fx_exposure"), F.concat(F.lit("exposed, not priced: "), F.array_join("foreign_currencies", ", "))).otherwise("none").alias("fx"),
        F.when(forward, "carry while delayed").otherwise("none").alias("timing"),
        F.when(contingent, "premium in every case").when(forward, "unwind").otherwise("none").alias("transaction_completion"),
        F.when(forward, "bid-offer of an early unwind").when(contingent, "none: it ends with the deal").otherwise("none").alias("hedge_unwind"),
    )
