"""Golden vectors of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella import dims
from tessella.functions import clauses, labels, normalize, text
from tessella.operators import compare, pricing, readings


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def many(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", column(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_registry_counts():
    assert len(dims.FIELDS) == 50 and sum(f[3] for f in dims.FIELDS) == 12
    have = lambda s: sum(f[4] is None or s in f[4] for f in dims.FIELDS)
    assert [have(s) for s in ("merger", "tender_offer", "takeover_offer", "scheme_of_arrangement")] == [48, 49, 48, 48]
    assert len(dims.STRUCTURE_SIGNATURES) == 19 and len(dims.MILESTONES) == 17


def test_printed_labels(spark):
    pages = ["some prose here\n62", "prose\n- 17 -", "a prose line\n2026", "text\niii", "text\nA-1", "text\nI-12", "", None]
    assert many(spark, pages, labels.printed_label) == ["62", "17", None, "iii", "A-1", "I-12", None, None]
    parsed = many(spark, ["62", "iii", "iv", "ix", "xlii", "A-1", "I-12", "not-a-label", None], labels.parse_label)
    assert [p and (p[0], p[1]) for p in parsed] == [("", 62), ("roman", 3), ("roman", 4), ("roman", 9), ("roman", 42), ("A", 1), ("I", 12), None, None]


def test_extension(spark):
    said = ["two successive periods of ninety (90) days", "by three (3) months", "twice by 90 days", "two 90-day extensions", "as the parties agree", "", None, "five periods of (30) days", "ten (10) business days"]
    got = many(spark, said, clauses.extension)
    assert [g and tuple(g) for g in got] == [(2, 90, "day"), (1, 3, "month"), (2, 90, "day"), (2, 90, "day"), None, None, None, (1, 30, "day"), (1, 10, "business day")]


def test_tenor(spark):
    got = many(spark, ["364 days after the Closing Date", "5 years", "18 months", "a 364-day facility", "none", None], clauses.tenor_years)
    assert got == [pytest.approx(364 / 365), 5.0, 1.5, pytest.approx(364 / 365), None, None]


def test_base_layer(spark):
    got = many(spark, ["agreement-ex2.1", "credit-agreement-ex10.1", "agreement-1", "filing-summary", "agreement-exa", ""], compare.base_layer)
    assert got == ["agreement", "credit-agreement", "agreement", "filing-summary", "agreement-exa", None]
    assert one(spark, "agreement-exa", lambda c: compare.base_layer(c, letters=True)) == "agreement"


def test_money(spark):
    said = ["$73.00 in cash", "€14.2bn", "USD 4bn", "Section 3 pays $250", "$250mn", "up to $250 million", "not to exceed $5m", "not exceeding $5m", "approximately up to $5m", " ", None]
    got = many(spark, said, normalize.money)
    assert [(g["value_num"], g["status"]) for g in got] == [(73.0, "ok"), (14.2e9, "ok"), (4e9, "ok"), (3.0, "ok"), (None, "unparseable"), (250e6, "ambiguous"), (5e6, "ambiguous"), (5e6, "ok"), (5e6, "ok"), (None, "empty"), (None, "empty")]
    assert [bool(g["qualifier"]) for g in got[5:9]] == [True] * 4


def test_embedded_amounts(spark):
    said = ["$250 monthly", "$5 business days", "EUR 14.200.000", "$250,000,000.", "no money", None]
    assert many(spark, said, normalize.embedded_amounts) == [[250e6], [5e9], [], [250e6], [], []]
    assert one(spark, "$250 monthly", lambda c: normalize.embedded_amounts(c, whole_words=True)) == [250.0]


def test_dates(spark):
    said = ["2026-06-25", "June 25, 2027", "25 June 2027", "Jun 25 2027", "06/25/2027", "June 25th, 2027", "the first anniversary of the date hereof", "dated as of June 25, 2027 by the parties", "next June sometime", ""]
    got = many(spark, said, normalize.date)
    assert [(g["value_text"], g["status"]) for g in got] == [("2026-06-25", "ok"), *[("2027-06-25", "ok")] * 5, (None, "ambiguous"), ("2027-06-25", "ok"), (None, "unparseable"), (None, "empty")]


def test_other_kinds(spark):
    assert [g["value_num"] for g in many(spark, ["66.7% of shares", "50 percent", "a majority of the votes", "two-thirds", "most"], normalize.percent)] == [pytest.approx(0.667), 0.5, 0.5, 2 / 3, None]
    assert [g["value_text"] for g in many(spark, ["$", "US$", "eur", "£5", "A$", "kr"], normalize.currency)] == ["USD", "USD", "EUR", "GBP", "USD", None]
    assert [g["value_bool"] for g in many(spark, ["Yes", "none", "perhaps"], normalize.boolean)] == [True, False, None]
    allowed = F.array(F.lit("tender_offer"), F.lit("merger"))
    assert [g["value_text"] for g in many(spark, ["Tender Offer", "tender-offer", "MERGER", "other"], lambda c: normalize.enum(c, allowed))] == ["tender_offer", "tender_offer", "merger", None]
    assert one(spark, "  a   b\nc ", normalize.text)["value_text"] == "a b c"
    kinds = spark.createDataFrame([("consideration_currency", "text", "$73"), ("target", "text", " A  B "), ("x", "odd", "y")], "f string, k string, r string")
    got = kinds.select(normalize.by_kind(F.col("f"), F.col("k"), F.lit(None).cast("array<string>"), F.col("r")).alias("n")).collect()
    assert [(r["n"]["value_text"], r["n"]["status"]) for r in got] == [("USD", "ok"), ("A B", "ok"), (None, "unparseable")]


def test_canonical_and_anchor(spark):
    assert many(spark, ["“Ab”  c–d", "ﬁne", None, "  "], text.canonical) == ['"ab" c-d', "fine", "", ""]
    a = many(spark, ["Some  Words", "some words", None], text.anchor)
    assert a[0] == a[1] and len(a[0]) == 16 and a[2] is None
    assert one(spark, None, text.content_hash) is not None


def test_locator_round_trip(spark):
    df = spark.createDataFrame([("doc_1", "agreement-ex2.1", 9, "A-9", "0123456789abcdef"), ("d", "l", 1, None, None)], "d string, l string, p int, b string, a string")
    got = df.select("*", text.locator_uri(F.col("d"), F.col("l"), F.col("p"), F.col("b"), F.col("a")).alias("u")).select("*", text.parse_locator(F.col("u")).alias("x")).collect()
    assert got[0]["u"] == "src://doc_1/agreement-ex2.1/pdf:9/doc:A-9#0123456789abcdef"
    for r in got:
        assert tuple(r["x"]) == (r["d"], r["l"], r["p"], r["b"], r["a"])
    assert one(spark, "http://x", text.parse_locator) is None
    cited = df.select(text.citation(F.col("l"), F.lit(None).cast("string"), F.col("b"), F.col("p")).alias("c")).collect()
    assert [r["c"] for r in cited] == ["agreement ex2.1, page A-9 (PDF page 9)", "l, PDF page 1"]


def test_evidence(spark):
    rows = [("the fee is due", "Here THE fee  is due.", True), ("other words", "Here the fee is due.", False), (None, "text", False), ("x", "", False)]
    df = spark.createDataFrame(rows, "q string, p string, ok boolean")
    got = df.select("ok", text.evidence(F.col("q"), text.anchor(F.col("q")), F.col("p")).alias("e")).collect()
    assert all(r["ok"] == r["e"]["ok"] and (r["e"]["reason"] is None) == r["ok"] for r in got)
    broken = df.limit(1).select(text.evidence(F.col("q"), F.lit("0" * 16), F.col("p")).alias("e")).first()["e"]
    assert not broken["anchor_intact"] and broken["found_on_page"] and not broken["ok"]


def test_small_numbers(spark):
    df = spark.createDataFrame([(4e9, 364.0)], "n double, d double")
    v = pricing.dv01(F.col("n"), 65_000.0)
    got = df.select(v.alias("v"), (pricing.dv01(F.col("n"), 65_000.0) * (F.col("d") / 365 / 7)).alias("s"), pricing.rate_pnl(v, F.lit(25.0)).alias("r"), pricing.rate_pnl(v, F.lit(0.0)).alias("z"), pricing.carry_cost(F.col("n"), 0.044, 0.0425, F.lit(90)).alias("c")).first()
    assert got["v"] == 2_600_000 and got["r"] == -65_000_000 and str(got["z"]) == "0.0"
    assert got["s"] == pytest.approx(2.6e6 * 364 / 365 / 7) and got["c"] == pytest.approx(1_479_452.05, abs=0.01)
    assert one(spark, 315_982, readings.tokens, "int") == int(315_982 / 2.9) + 1
    assert one(spark, 1.42e10, text.number_text, "double") == "14200000000.0"
    assert one(spark, "x" * 40, lambda c: text.clipped(c, 10)).startswith("x" * 10 + " …")
    _ = dt
