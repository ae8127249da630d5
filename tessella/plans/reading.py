"""The reading path: labels, locators, normalizers, model readings, regions, ranks and
inventories, on orders, line items, events, labels and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions import labels, normalize, text
from tessella.operators import compare, filing, layers, pages, readings, review, timeline
from tessella.plans import documents, fields, orders
from tessella.sources import store
from tessella.sources.tables import table


def printed_labels(spark, sf_dir):
    """Labels read off the edges of a page: lettered, plain, roman, a year, none."""
    k = F.col("o_orderkey")
    n = (k % 90 + 1).cast("string")
    last = F.when(k % 6 == 0, F.concat(F.lit("A-"), n)).when(k % 6 == 1, F.concat(F.lit("- "), n, F.lit(" -"))).when(k % 6 == 2, F.lit("xiv")).when(k % 6 == 3, F.lit("2024")).when(k % 6 == 4, F.concat(F.lit("[C-"), n, F.lit("]"))).otherwise(F.lit("the end"))
    page = F.concat(F.lit("first line here\nsecond line of it\n"), F.col("o_orderpriority"), F.lit("\nbody text goes on\n  "), last, F.lit("  \n\n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", labels.printed_label(page).alias("label"))
    parsed = labels.parse_label(F.col("label"))
    return o.select("o_orderkey", "label", parsed["series"].alias("series"), parsed["ordinal"].cast("long").alias("ordinal"))


def locator_parts(spark, sf_dir):
    """Locators written and read back, with and without label and anchor."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    label = F.when(k % 3 == 0, F.concat(F.lit("A-"), (k % 50).cast("string")))
    mark = F.when(k % 2 == 0, F.substring(F.md5(k.cast("string")), 1, 16))
    uri = F.when(k % 11 == 0, F.lit("http://x/y")).otherwise(text.locator_uri(F.concat(F.lit("doc_"), k.cast("string")), F.lit("agreement"), k % 50, label, mark))
    out = o.select("o_orderkey", uri.alias("uri"))
    p = text.parse_locator(F.col("uri"))
    return out.select("o_orderkey", "uri", p["document_id"].alias("document_id"), p["layer_id"].alias("layer_id"), p["pdf_page"].cast("long").alias("pdf_page"), p["printed_page"].alias("printed_page"), p["anchor"].alias("anchor"))


def citations(spark, sf_dir):
    k = F.col("o_orderkey")
    said = text.citation(F.lit("credit-agreement"), F.when(k % 4 == 0, F.col("o_orderpriority")).when(k % 4 == 1, ""), F.when(k % 3 == 0, F.lit("B-7")), k % 100)
    return table(spark, sf_dir, "orders").select("o_orderkey", said.alias("citation"))


def number_texts(spark, sf_dir):
    """Numbers as text, and long cells cut with a note of their length."""
    o = orders.priced(spark, sf_dir)
    long = F.repeat(F.lit("ab"), (F.col("o_orderkey") % 40 * 500).cast("int"))
    return o.select("o_orderkey", text.number_text(F.col("cents") / F.lit(100.0)).alias("amount"), F.sha2(text.clipped(long), 256).alias("cell"))


def other_norms(spark, sf_dir):
    """Percentages, yes and no, and currencies."""
    k = F.col("o_orderkey")
    share = F.when(k % 5 == 0, F.concat((k % 100).cast("string"), F.lit(" % of the shares"))).when(k % 5 == 1, "a majority of the votes").when(k % 5 == 2, F.concat((k % 100).cast("string"), F.lit(".5 percent"))).when(k % 5 == 3, "  ").otherwise("some of it")
    flag = F.when(k % 4 == 0, " YES ").when(k % 4 == 1, "none").when(k % 4 == 2, "perhaps")
    money = F.when(k % 4 == 0, "eur").when(k % 4 == 1, "paid in £").when(k % 4 == 2, "in shells").otherwise("USD")
    n = table(spark, sf_dir, "orders").select("o_orderkey", normalize.percent(share).alias("p"), normalize.boolean(flag).alias("b"), normalize.currency(money).alias("c"))
    return n.select("o_orderkey", F.round("p.value_num", 6).alias("share"), F.col("p.status").alias("share_status"), F.col("b.value_bool").alias("flag"), F.col("b.status").alias("flag_status"), F.col("c.value_text").alias("currency"), F.col("c.status").alias("currency_status"))


def _asked(spark, sf_dir):
    """Requests of orders: three asked lines each over pages 10 to 14, some lines answered."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("document_id"), "o_orderkey")
    spread = F.explode(F.array(*[F.lit(f"line{i}") for i in (1, 2, 3)])).alias("field_name")
    wanted = o.select("document_id", F.lit("agreement").alias("qualified_layer_id"), F.lit(0).alias("chunk_index"), spread, F.array(*[F.lit(p) for p in range(10, 15)]).alias("page_map"))
    li = table(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    said = li.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("document_id"), F.lit("agreement").alias("qualified_layer_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("line"), n.cast("string")).alias("field_name"),
        F.lit(0).alias("reading_index"), (q < 40).alias("found"), F.concat(F.lit("  "), F.col("l_returnflag"), F.lit(" ")).alias("raw_value"), F.lit("").alias("evidence"), F.lit("s").alias("section"), (q % 7).cast("int").alias("page"),
        F.when(q % 5 == 0, "high").otherwise((q / 25).cast("string")).alias("confidence"),
    )
    return wanted, said


def read_records(spark, sf_dir):
    """Readings indexed against what was asked, and mapped to pages."""
    wanted, said = _asked(spark, sf_dir)
    out = readings.to_records(readings.index_readings(said.withColumn("run_id", F.lit("r")), wanted))
    return out.select("document_id", "field_name", "raw_value", "evidence", F.col("pdf_page").cast("long").alias("pdf_page"), F.round("confidence", 6).alias("confidence"), "status", "review_status", F.size("notes").cast("long").alias("n_notes"))


def unknown_fields(spark, sf_dir):
    wanted, said = _asked(spark, sf_dir)
    out = readings.unknown_names(said, wanted)
    return out.select("document_id", "n_unknown", F.array_join("names", ",").alias("names"))


def omitted_and_absent(spark, sf_dir):
    """Omitted fields stay unresolved; absences beside unreadable pages say so."""
    wanted, said = _asked(spark, sf_dir)
    records = readings.to_records(readings.index_readings(said.withColumn("run_id", F.lit("r")), wanted))
    controlled = records.withColumns({"status": F.when(F.col("raw_value").isNotNull(), "found").otherwise("not_found"), "review_status": F.lit("unreviewed")})
    blind = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 == 0).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("document_id"), F.lit("agreement").alias("qualified_id"), F.explode(F.array(F.lit(14), F.lit(12))).alias("pdf_page"))
    out = readings.qualify_absences(readings.keep_omitted(controlled, records), blind)
    return out.select("document_id", "field_name", "status", "review_status", F.get("notes", F.size("notes") - 1).alias("last_note"))


def token_sums(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    runs = li.select(F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").alias("run_id"), F.col("l_partkey").alias("input_tokens"), F.col("l_quantity").cast("long").alias("output_tokens"), F.lit(2).cast("long").alias("cache_read_tokens"), F.col("l_orderkey").alias("cache_creation_tokens"))
    out = readings.token_totals(runs)
    return out.select("document_id", "run_id", "input_tokens", "output_tokens", "billed_input_tokens")


def request_texts(spark, sf_dir):
    """Text of each request over a source's documents."""
    p = documents.filing_pages(spark, sf_dir).withColumn("char_count", F.length("text"))
    packed = readings.pack_pages(p.select("document_id", "pdf_page", "char_count"), ["document_id"], budget=F.lit(5000).cast("long"), page_limit=F.lit(8))
    out = readings.excerpts(p, packed, ["document_id"])
    return out.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("excerpt", 256).alias("excerpt_sha256"))


def cost_gate(spark, sf_dir):
    from tessella import dims

    p = documents.filing_pages(spark, sf_dir, char_count=F.length("text"))
    e = readings.within_ceiling(readings.estimate(p, ["document_id"], dims.model_prices(spark), overhead_tokens=3000), 1.2)
    return e.select("document_id", F.round("cost_high", 6).alias("cost_high"), "allowed")


def contents_cut(spark, sf_dir):
    """A long table of contents keeps its dense head."""
    e = table(spark, sf_dir, "events")
    p = e.select(F.col("user_id").alias("document_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pdf_page"))
    dense = F.lit("\n1\n2\n3\n4\n5")
    said = F.when(F.col("pdf_page") == 1, F.concat(F.lit("Contents"), dense)).when(F.col("pdf_page") <= F.col("document_id") % 4 + 1, F.concat(F.lit("more"), dense)).otherwise("plain text")
    p = p.withColumn("text", said)
    whole = layers.segment_layers(p, p.where("false").select("document_id", "pdf_page", F.lit("").alias("layer_id"), F.lit("").alias("exhibit_number"), F.lit("").alias("evidence")))
    out = layers.segment_regions(p, whole, (("table-of-contents", "^contents", "Contents"),))
    return out.select("document_id", "region_id", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"))


def page_marks(spark, sf_dir):
    """Exhibit labels on short first lines, and the first signature of a head."""
    k = F.col("o_orderkey")
    first = F.when(k % 4 == 0, "Exhibit 10.1").when(k % 4 == 1, "EXHIBIT 2.1").when(k % 4 == 2, "this exhibit 2.1 is named in a long line of text").otherwise("plain")
    said = F.concat(first, F.lit("\n"), F.col("o_orderpriority"), F.lit("\nrest"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", layers.exhibit_label(said).alias("exhibit"), layers.first_signature(text.page_head(said), (("high", r"2-HIGH", "High"), ("any", r"\d-[A-Z]", "Any"))).alias("s"))
    return o.select("o_orderkey", F.nullif("exhibit", F.lit("")).alias("exhibit"), F.col("s.id").alias("signature"), F.col("s.label").alias("label"))


def layer_lookups(spark, sf_dir):
    """First layer of a kind, and the pages to scan for the structure."""
    p = documents.headed(spark, sf_dir)
    parts = layers.segment_layers(p, documents.marks(spark, sf_dir))
    none = layers.segment_regions(p, parts, ())
    first = layers.layer_of_kind(parts, "agreement").select("document_id", "qualified_id")
    n = layers.pages_to_scan(p.select("document_id", "pdf_page"), parts, none).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return n.join(first, "document_id", "left").select("document_id", F.col("qualified_id").alias("agreement"), "n_pages")


def blind_pages(spark, sf_dir):
    """Image-only body pages in the layers in scope, and what ingestion warns of."""
    p = documents.filing_pages(spark, sf_dir, char_count=F.length("text"), text=F.lit(""))
    p = p.withColumn("text_layer_status", pages.text_layer_status(F.col("char_count"), F.col("has_images"), 600, 700))
    parts = layers.segment_layers(p, documents.marks(spark, sf_dir))
    return layers.unreadable_in_scope(p.select("document_id", "pdf_page", "text_layer_status"), parts, layers.segment_regions(p, parts, ())).select("document_id", F.col("pdf_page").cast("long").alias("pdf_page"), "qualified_id")


def layer_warnings(spark, sf_dir):
    p = documents.filing_pages(spark, sf_dir, char_count=F.length("text"))
    parts = layers.segment_layers(p, documents.marks(spark, sf_dir))
    found = p.select("document_id").distinct().withColumn("structure", F.when(F.length("document_id") % 2 == 0, "merger").otherwise("unknown"))
    return layers.warnings(parts, found).select("document_id", F.array_join("warnings", "; ").alias("warnings"))


def ingestion_ladder(spark, sf_dir):
    """Integrity of a source's pages and the ladder that follows from it."""
    rows = pages.reconcile_labels(documents.sized(spark, sf_dir).withColumn("printed_page", F.lit(None).cast("string")))
    return pages.ingestion_status(rows).select("document_id", "has_errors", "has_warnings", "ingestion_status")


def integrity_list(spark, sf_dir):
    """Every issue of a source's pages, with kind and pages."""
    rows = pages.reconcile_labels(documents.sized(spark, sf_dir).withColumn("printed_page", F.lit(None).cast("string")))
    out = pages.integrity_issues(rows)
    return out.select("document_id", "kind", "severity", documents.joined("pdf_pages").alias("pages"), F.col("issue_order").cast("long").alias("issue_order"))


def cmp_triage(spark, sf_dir):
    """Each field's place in its document's triage order, with the reason of its class."""
    c = compare.triage_ranked(compare.compare(orders.two_sources(spark, sf_dir)))
    return c.select("document_id", "field_name", "classification", F.col("place").cast("long").alias("place"))


def timeline_order(spark, sf_dir):
    """Each entry's place in its document's timeline."""
    t = timeline.numbered(timeline.build(compare.compare(orders.deal_rows(spark, sf_dir))))
    return t.select("document_id", "event", "basis", F.date_format("resolved_date", "yyyy-MM-dd").alias("resolved_date"), F.col("place").cast("long").alias("place")).where("place <= 2")


def review_decisions(spark, sf_dir):
    """The latest decision of a known kind decides the review status."""
    rows = fields.judged(spark, sf_dir)
    k = F.col("document_id").cast("long")
    say = lambda seq, status: rows.where((F.col("document_layer") == "filing-summary") & (k % 2 == 0)).select("document_id", "field_name", "document_layer", "run_id", F.lit(seq).cast("long").alias("edit_seq"), status.alias("review_status"), F.lit("n").alias("note"))
    said = say(1, F.lit("verified")).unionByName(say(2, F.when(k % 3 == 0, "exception").otherwise("odd")))
    kinds = dict(x.strip().split(" ", 1) for x in schemas.DECISIONS.split(", "))
    said = said.select(*[(F.col(c) if c in said.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    return review.with_decisions(rows, said).select("document_id", "document_layer", "review_status")


def store_counts(spark, sf_dir):
    """Inventory of a store: how many fields are found, withheld, absent, in review."""
    rows = orders.two_sources(spark, sf_dir)
    docs = rows.select("document_id").distinct().withColumn("filename", F.concat("document_id", F.lit(".pdf")))
    issues = docs.where(F.length("document_id") == 2).select("document_id")
    out = filing.counts(docs, rows, issues)
    return out.select("document_id", "filename", *[F.col(c).cast("long").alias(c) for c in ("found", "withheld", "not_found", "not_applicable", "in_review", "issues")])


def json_export(spark, sf_dir):
    """Rows as JSON texts, nulls included."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return filing.json_rows(o.select(F.concat(F.lit("o"), k.cast("string")).alias("document_id"), k.alias("n"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("clerk"), (k % 2 == 0).alias("even")))


def clipped_cells(spark, sf_dir):
    """Text columns as spreadsheet cells."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.repeat("text", 8).alias("text"), "lang")
    return store.cells(d).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang")


QUERIES = {
    f.__name__: f
    for f in (
        printed_labels, locator_parts, citations, number_texts, other_norms, read_records, unknown_fields, omitted_and_absent, token_sums, request_texts, cost_gate, contents_cut, page_marks,
        layer_lookups, blind_pages, layer_warnings, ingestion_ladder, integrity_list, cmp_triage, timeline_order, review_decisions, store_counts, json_export, clipped_cells,
    )
}

_READ = """a AS (SELECT 'o' || o_orderkey AS document_id, o_orderkey AS k, unnest([1, 2, 3]) AS n FROM orders),
r AS (SELECT a.document_id, a.k, 'line' || a.n AS field_name, l_quantity AS q, l_returnflag AS m, l_orderkey IS NOT NULL AS answered FROM a LEFT JOIN lineitem ON l_orderkey = a.k AND l_linenumber = a.n)"""
_LAST_NOTE = "CASE WHEN NOT answered THEN 'the model gave no answer for this field' WHEN q < 40 AND NOT (q::INT % 7 BETWEEN 1 AND 5) THEN 'page ' || (q::INT % 7) || ' is outside the excerpt' WHEN q < 40 AND q::INT % 5 = 0 THEN 'confidence is not a number; taken as 0' END"
_P, _M, _L, _Q = documents._PAGES, documents._MARKS, documents._LAYERS, documents._QUALIFIED
_DUP = documents.ORACLES["dup_severity"].split("SELECT document_id, string_agg", 1)[0]

ORACLES = {
    "printed_labels": """SELECT o_orderkey, label, CASE WHEN label IS NULL THEN NULL WHEN o_orderkey % 6 = 0 THEN 'A' WHEN o_orderkey % 6 = 1 THEN '' WHEN o_orderkey % 6 = 2 THEN 'roman' ELSE 'C' END AS series,
CASE o_orderkey % 6 WHEN 2 THEN 14 WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE o_orderkey % 90 + 1 END AS ordinal
FROM (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'A-' || (o_orderkey % 90 + 1) WHEN 1 THEN (o_orderkey % 90 + 1)::VARCHAR WHEN 2 THEN 'xiv' WHEN 4 THEN 'C-' || (o_orderkey % 90 + 1) END AS label FROM orders)""",
    "locator_parts": """WITH u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'A-' || (o_orderkey % 50) END AS printed_page, CASE WHEN o_orderkey % 2 = 0 THEN substr(md5(o_orderkey::VARCHAR), 1, 16) END AS anchor, o_orderkey % 11 <> 0 AS good FROM orders)
SELECT o_orderkey, CASE WHEN good THEN 'src://doc_' || o_orderkey || '/agreement/pdf:' || (o_orderkey % 50) || coalesce('/doc:' || printed_page, '') || coalesce('#' || anchor, '') ELSE 'http://x/y' END AS uri,
CASE WHEN good THEN 'doc_' || o_orderkey END AS document_id, CASE WHEN good THEN 'agreement' END AS layer_id, CASE WHEN good THEN o_orderkey % 50 END AS pdf_page, CASE WHEN good THEN printed_page END AS printed_page, CASE WHEN good THEN anchor END AS anchor FROM u""",
    "citations": """SELECT o_orderkey, 'credit agreement, ' || CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority || ', ' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'page B-7 (PDF page ' || (o_orderkey % 100) || ')' ELSE 'PDF page ' || (o_orderkey % 100) END AS citation FROM orders""",
    "number_texts": """WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS v, o_orderkey % 40 * 1000 AS n FROM orders)
SELECT o_orderkey, (v // 100) || '.' || CASE WHEN v % 100 = 0 THEN '0' WHEN v % 10 = 0 THEN ((v % 100) // 10)::VARCHAR ELSE lpad((v % 100)::VARCHAR, 2, '0') END AS amount,
sha256(CASE WHEN n > 32000 THEN repeat('ab', 16000) || ' … [' || format('{:,}', n) || ' characters]' ELSE repeat('ab', (n // 2)::INT) END) AS cell FROM o""",
    "other_norms": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 100) / 100.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN round(((o_orderkey % 100) + 0.5::DOUBLE) / 100.0::DOUBLE, 6) END AS share, CASE WHEN o_orderkey % 5 = 3 THEN 'empty' WHEN o_orderkey % 5 = 4 THEN 'ambiguous' ELSE 'ok' END AS share_status,
CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE o_orderkey % 4 WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'empty' ELSE 'ok' END AS flag_status, CASE o_orderkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 3 THEN 'USD' END AS currency, CASE WHEN o_orderkey % 4 = 2 THEN 'unparseable' ELSE 'ok' END AS currency_status FROM orders""",
    "read_records": f"""WITH {_READ} SELECT document_id, field_name, CASE WHEN q < 40 THEN m END AS raw_value, NULL::VARCHAR AS evidence, CASE WHEN q < 40 AND q::INT % 7 BETWEEN 1 AND 5 THEN 9 + q::INT % 7 END::BIGINT AS pdf_page,
CASE WHEN q < 40 AND q::INT % 5 <> 0 THEN least(round(q / 25.0::DOUBLE, 6), 1.0) ELSE 0.0::DOUBLE END AS confidence, CASE WHEN answered THEN 'not_found' ELSE 'unresolved' END AS status, CASE WHEN answered THEN 'unreviewed' ELSE 'exception' END AS review_status,
((NOT answered)::INT + coalesce(q < 40 AND q::INT % 5 = 0, false)::INT + coalesce(q < 40 AND NOT (q::INT % 7 BETWEEN 1 AND 5), false)::INT)::BIGINT AS n_notes FROM r""",
    "unknown_fields": "SELECT 'o' || l_orderkey AS document_id, count(*) AS n_unknown, array_to_string(list_sort(list(DISTINCT 'line' || l_linenumber))[1:5], ',') AS names FROM lineitem WHERE l_linenumber > 3 GROUP BY l_orderkey",
    "omitted_and_absent": f"""WITH {_READ}, s AS (SELECT *, CASE WHEN NOT answered THEN 'unresolved' WHEN q < 40 THEN 'found' ELSE 'not_found' END AS status, {_LAST_NOTE} AS note FROM r)
SELECT document_id, field_name, status, CASE WHEN answered THEN 'unreviewed' ELSE 'exception' END AS review_status, CASE WHEN status = 'not_found' AND k % 3 = 0 THEN 'absence is not certain: unreadable pages 12, 14' ELSE note END AS last_note FROM s""",
    "token_sums": "SELECT l_suppkey AS document_id, l_linenumber AS run_id, sum(l_partkey)::BIGINT AS input_tokens, sum(l_quantity::BIGINT)::BIGINT AS output_tokens, (sum(l_partkey) + 2 * count(*) + sum(l_orderkey))::BIGINT AS billed_input_tokens FROM lineitem GROUP BY 1, 2",
    "request_texts": documents.ORACLES["pack_chunks"].replace("length(text) / 2.9)::BIGINT + 1 AS t FROM documents)", "length(text) / 2.9)::BIGINT + 1 AS t, text FROM documents)").split("\nSELECT document_id, chunk", 1)[0]
    + """, x AS (SELECT f.document_id, f.chunk AS chunk_index, f.page, row_number() OVER (PARTITION BY f.document_id, f.chunk ORDER BY f.page) AS place, p.text FROM f JOIN p ON p.document_id = f.document_id AND p.page = f.page)
SELECT document_id, chunk_index, sha256(string_agg('[PAGE ' || place || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY place)) AS excerpt_sha256 FROM x GROUP BY 1, 2""",
    "cost_gate": f"SELECT document_id, cost_high, cost_high <= 1.2 AS allowed FROM ({documents.ORACLES['run_estimate']})",
    "contents_cut": """WITH n AS (SELECT user_id AS d, count(*) AS n, user_id % 4 + 1 AS dense FROM events GROUP BY 1)
SELECT d AS document_id, 'table-of-contents' AS region_id, 1::BIGINT AS start_page, CASE WHEN n > 6 THEN dense ELSE n END AS end_page FROM n UNION ALL SELECT d, 'body', dense + 1, n FROM n WHERE n > 6 AND dense < n""",
    "page_marks": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '10.1' WHEN 1 THEN '2.1' END AS exhibit, CASE WHEN o_orderpriority = '2-HIGH' THEN 'high' WHEN regexp_matches(o_orderpriority, '[0-9]-[A-Z]') THEN 'any' END AS signature, CASE WHEN o_orderpriority = '2-HIGH' THEN 'High' WHEN regexp_matches(o_orderpriority, '[0-9]-[A-Z]') THEN 'Any' END AS label FROM orders",
    "layer_lookups": f"""WITH {_P}, {_M}, {_L}, y AS (SELECT document_id, {_Q} AS qualified_id, layer_id, start_page, end_page FROM l),
a AS (SELECT document_id, arg_min(qualified_id, start_page) AS agreement, sum(end_page - start_page + 1) AS n FROM y WHERE layer_id = 'agreement' GROUP BY 1)
SELECT n.document_id, a.agreement, coalesce(a.n, n.pages)::BIGINT AS n_pages FROM n LEFT JOIN a USING (document_id)""",
    "blind_pages": f"""WITH {_P}, {_M}, {_L} SELECT p.document_id, p.pdf_page, {_Q} AS qualified_id FROM p JOIN l ON p.document_id = l.document_id AND p.pdf_page BETWEEN l.start_page AND l.end_page
WHERE l.layer_id = 'agreement' AND length(p.text) < 600 AND p.has_images""",
    "layer_warnings": f"""WITH {_P}, {_M}, {_L} SELECT document_id, concat_ws('; ', CASE WHEN NOT bool_or(layer_id = 'agreement') THEN 'no agreement layer' END, 'no summary layer', CASE WHEN length(document_id) % 2 <> 0 THEN 'unknown structure' END) AS warnings FROM l GROUP BY 1""",
    "ingestion_ladder": f"""{_DUP.rstrip()}, i AS (SELECT document_id, CASE WHEN arg_min(char_count, pdf_page) >= greatest(200, floor(any_value(median) * 0.3)) THEN 'error' ELSE 'info' END AS severity FROM c JOIN med USING (document_id) GROUP BY document_id, h HAVING count(*) > 1),
s AS (SELECT document_id, {documents._STATUS} AS st FROM p), a AS (SELECT document_id, bool_or(st = 'image_only') AS ocr, bool_or(st = 'sparse') AS sparse FROM s GROUP BY 1), e AS (SELECT document_id, bool_or(severity = 'error') AS err FROM i GROUP BY 1),
z AS (SELECT a.document_id, ocr OR coalesce(err, false) AS has_errors, sparse AS has_warnings, ocr FROM a LEFT JOIN e USING (document_id))
SELECT document_id, has_errors, has_warnings, CASE WHEN ocr THEN 'ocr_required' WHEN has_errors THEN 'review_required' WHEN has_warnings THEN 'ingested_with_warnings' ELSE 'ingested' END AS ingestion_status FROM z""",
    "integrity_list": f"""{_DUP.rstrip()}, s AS (SELECT document_id, pdf_page, {documents._STATUS} AS st FROM p)
SELECT document_id, 'duplicate_page' AS kind, CASE WHEN arg_min(char_count, pdf_page) >= greatest(200, floor(any_value(median) * 0.3)) THEN 'error' ELSE 'info' END AS severity, string_agg(pdf_page::VARCHAR, ',' ORDER BY pdf_page) AS pages, 0::BIGINT AS issue_order FROM c JOIN med USING (document_id) GROUP BY document_id, h HAVING count(*) > 1
UNION ALL SELECT document_id, CASE st WHEN 'blank' THEN 'blank_page' ELSE 'unreadable_page' END, CASE st WHEN 'image_only' THEN 'error' WHEN 'blank' THEN 'info' ELSE 'warning' END, string_agg(pdf_page::VARCHAR, ',' ORDER BY pdf_page), 1 FROM s WHERE st <> 'machine_readable' GROUP BY document_id, st""",
    "cmp_triage": f"""WITH {orders._PRICED}, {orders._CLASS} SELECT document_id, field_name, classification, row_number() OVER (PARTITION BY document_id ORDER BY list_position(['conflict', 'agreement_only', 'summary_only', 'unresolved', 'normalized_match', 'match', 'not_applicable'], classification), field_name) AS place FROM cmp""",
    "timeline_order": f"""WITH {orders._CLAUSE} SELECT document_id, 'Agreement signed' AS event, 'extracted' AS basis, strftime(signed, '%Y-%m-%d') AS resolved_date, 1::BIGINT AS place FROM d
UNION ALL SELECT document_id, 'Initial outside date', 'extracted', strftime(outside, '%Y-%m-%d'), 2 FROM d""",
    "review_decisions": f"""WITH {fields._JUDGED} SELECT document_id, document_layer, CASE WHEN document_layer = 'filing-summary' AND doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'exception' ELSE 'verified' END ELSE review_status END AS review_status FROM j""",
    "store_counts": f"""WITH {orders._PRICED}, f AS (SELECT 'o' || (k % 97) AS d, CASE WHEN k % 7 = 5 THEN 'not_found' WHEN k % 14 = 6 THEN 'not_applicable' ELSE 'found' END AS s FROM o UNION ALL SELECT 'o' || (k % 97), CASE WHEN k % 14 = 13 THEN 'unresolved' ELSE 'found' END FROM o WHERE k % 7 <> 4)
SELECT d AS document_id, d || '.pdf' AS filename, count(*) FILTER (s = 'found') AS found, count(*) FILTER (s = 'unresolved') AS withheld, count(*) FILTER (s = 'not_found') AS not_found, count(*) FILTER (s = 'not_applicable') AS not_applicable, 0::BIGINT AS in_review, (length(d) = 2)::BIGINT AS issues FROM f GROUP BY 1""",
    "json_export": """SELECT 'o' || o_orderkey AS document_id, '{"document_id":"o' || o_orderkey || '","n":' || o_orderkey || ',"clerk":' || CASE WHEN o_orderkey % 3 = 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || ',"even":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS json FROM orders""",
    "clipped_cells": "SELECT doc_id, sha256(CASE WHEN length(t) > 32000 THEN substr(t, 1, 32000) || ' … [' || format('{:,}', length(t)) || ' characters]' ELSE t END) AS text_sha256, lang FROM (SELECT doc_id, repeat(text, 8) AS t, lang FROM documents)",
}
