"""Page, layer, structure and packing operators on the ``documents`` table.

Sources stand for filings and their documents, in id order, for pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import layers, pages, readings, structure
from tessella.sources.tables import table

#: Words of a quote that its candidate pages must share.
GRAM = 5
BOUNDARY = "Licensed under|Released under|This work is licensed"
REGIONS = (("article", r"^(?:the|der|die|la|le) ", "Starts with an article"), ("vowel", r"^[aeiou]", "Starts with a vowel"))
SIGNATURES = (
    ("licensed", r"licensed\s+under", 10, "licence line"),
    ("licensed", r"released\s+under", 6, "release line"),
    ("noisy", r"[#$%&*]{3}", 4, "symbols"),
    ("noisy", r"!!", 3, "shouting"),
    ("contact", r"\btoken\b", 9, "token"),
    ("contact", r"@", 7, "address"),
)


def filing_pages(spark: SparkSession, sf_dir: str, **narrow) -> DataFrame:
    """Documents as pages. ``narrow`` columns are made from the text before pages are
    numbered, and then only they pass through the shuffle; else texts meet their
    numbers by document id, which no source can skew."""
    docs = table(spark, sf_dir, "documents")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    images = (F.col("doc_id") % 2 == 0).alias("has_images")
    rows = docs.select(F.col("source").alias("document_id"), "source", "doc_id", images, *[c.alias(n) for n, c in narrow.items()])
    rows = rows.withColumn("pdf_page", nth).drop("source")
    if narrow:
        return rows
    texts = docs.select(F.col("doc_id").alias("t_id"), "text")
    return rows.join(texts, F.col("doc_id") == F.col("t_id")).drop("t_id")


def _chars():
    return F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the columns that the integrity operators need."""
    p = filing_pages(spark, sf_dir, char_count=_chars(), content_hash=text.content_hash(F.col("text")))
    return p.withColumn("text_layer_status", pages.text_layer_status(F.col("char_count"), F.col("has_images")))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose text is their head, all that regions are told by."""
    return filing_pages(spark, sf_dir, text=text.page_head(F.col("text"), layers.REGION_HEAD))


def joined(pages_: str):
    return F.array_join(F.transform(pages_, lambda p: p.cast("string")), ",")


def page_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", _chars().alias("char_count"))
    return d.select("doc_id", F.col("char_count").cast("long").alias("char_count"), pages.text_layer_status(F.col("char_count"), F.col("doc_id") % 2 == 0).alias("text_layer_status"))


def content_dups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


def dup_severity(spark, sf_dir):
    return pages.duplicate_issues(sized(spark, sf_dir)).select("document_id", joined("pdf_pages").alias("pages"), "severity")


def readability(spark, sf_dir):
    r = pages.readability(sized(spark, sf_dir))
    return r.select("document_id", *[joined(c).alias(c) for c in ("unreadable", "blank", "sparse")])


def inventory_rollup(spark, sf_dir):
    return pages.inventory(sized(spark, sf_dir)).select("document_id", "page_count", F.col("total_chars").cast("long").alias("total_chars"), "requires_ocr", "has_degraded_text", "is_machine_readable")


def marks(spark, sf_dir):
    p = filing_pages(spark, sf_dir, marked=F.col("text").rlike(BOUNDARY), main=F.col("text").rlike("Apache")).where("marked")
    return p.select("document_id", "pdf_page", F.when(F.col("main"), "agreement").otherwise("exhibit").alias("layer_id"), F.lit(None).cast("string").alias("exhibit_number"), F.lit("licence line").alias("evidence"))


def layer_segments(spark, sf_dir):
    out = layers.segment_layers(filing_pages(spark, sf_dir, char_count=F.length("text")), marks(spark, sf_dir))
    return out.select("document_id", "qualified_id", "layer_id", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"), F.col("ordinal").cast("long").alias("ordinal"))


def region_segments(spark, sf_dir):
    p = headed(spark, sf_dir)
    whole = layers.segment_layers(p, marks(spark, sf_dir).where("false"))
    out = layers.segment_regions(p, whole, REGIONS)
    return out.select("document_id", "region_id", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"))


def body_pages(spark, sf_dir):
    """Pages of licence-led layers, without the regions that start with an article."""
    p = headed(spark, sf_dir)
    parts = layers.segment_layers(p, marks(spark, sf_dir))
    skip = layers.segment_regions(p, layers.segment_layers(p, marks(spark, sf_dir).where("false")), REGIONS)
    skip = skip.withColumn("region_id", F.when(F.col("region_id") == "article", "table-of-contents").otherwise(F.col("region_id")))
    return layers.body_pages(p.select("document_id", "pdf_page"), parts, skip).select("document_id", F.col("pdf_page").cast("long").alias("pdf_page"), "qualified_id")


def structure_scores(spark, sf_dir):
    found = structure.evidence(filing_pages(spark, sf_dir), SIGNATURES)
    s = structure.scores(found)
    return s.select("document_id", "structure", "score", F.col("rank").cast("long").alias("rank"))


def structure_class(spark, sf_dir):
    p = filing_pages(spark, sf_dir)
    c = structure.classify(p, structure.scores(structure.evidence(p, SIGNATURES)))
    return c.select("document_id", "structure", "confidence", F.array_join("secondary_structures", ",").alias("secondary"), "review_status")


def grams(words, n):
    """Hashes of each run of n words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))
    return F.array_distinct(F.when(F.size(words) >= n, runs))


def quotes_found(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """``doc_id, item_id`` and the evidence check for each quote (item_id, quote) that a document holds.

    The words between a quote's first and last one stand whole in a page that holds
    it, so hashes of up to ``GRAM`` of them find the candidates; each is verified.
    Quotes of one or two words have no such inside and are searched in every page.
    """
    d = docs.select("doc_id", "text").withColumn("page", text.canonical(F.col("text")))
    q = quotes.select("item_id", "quote").withColumn("needle", text.canonical(F.col("quote"))).where("needle <> ''")
    q = q.withColumn("words", F.split("needle", " ")).withColumn("n", F.least(F.size("words") - 2, F.lit(GRAM)))
    keyed = q.where("n > 0")
    keys = keyed.select("item_id", "n", F.element_at(grams(F.slice("words", 2, F.col("n")), F.col("n")), 1).alias("key"))
    sizes = keyed.select("n").distinct()
    runs = d.select("doc_id", F.split("page", " ").alias("page_words")).join(F.broadcast(sizes), F.size("page_words") >= F.col("n"))
    runs = runs.select("doc_id", "n", grams(F.col("page_words"), F.col("n")).alias("keys")).select("doc_id", "n", F.explode("keys").alias("key"))
    near = runs.join(keys, ["n", "key"]).select("doc_id", "item_id")
    brief = q.where("n <= 0").select("item_id", "needle")
    near = near.unionByName(d.join(brief, F.contains("page", "needle")).select("doc_id", "item_id")).distinct()
    near = near.select(F.col("doc_id").alias("near_doc"), F.col("item_id").alias("near_item"))
    rows = docs.select("doc_id", "text").join(near, F.col("doc_id").eqNullSafe(F.col("near_doc")))
    rows = rows.join(quotes.select("item_id", "quote"), F.col("item_id").eqNullSafe(F.col("near_item")))
    e = text.evidence(F.col("quote"), text.anchor(F.col("quote")), F.col("text"))
    return rows.select("doc_id", "item_id", e.alias("e")).select("doc_id", "item_id", "e.anchor_intact", "e.found_on_page", "e.ok").where("found_on_page")


def evidence_check(spark, sf_dir):
    """Every benchmark passage as a quote against every document."""
    return quotes_found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote")))


def pack_chunks(spark, sf_dir):
    p = filing_pages(spark, sf_dir, char_count=F.length("text"))
    packed = readings.pack_pages(p, ["document_id"], budget=F.lit(5000).cast("long"), page_limit=F.lit(8))
    out = packed.select("document_id", F.posexplode("chunks").alias("chunk_index", "c"))
    return out.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c")[0].cast("long").alias("first_page"), F.size("c").cast("long").alias("n_pages"))


def run_estimate(spark, sf_dir):
    from tessella import dims

    p = filing_pages(spark, sf_dir, char_count=F.length("text"))
    e = readings.estimate(p, ["document_id"], dims.model_prices(spark), overhead_tokens=3000)
    return e.select("document_id", "pages", "requests", "input_tokens", F.round("cost_low", 6).alias("cost_low"), F.round("cost_high", 6).alias("cost_high"))


QUERIES = {f.__name__: f for f in (page_status, content_dups, dup_severity, readability, inventory_rollup, layer_segments, region_segments, body_pages, structure_scores, structure_class, evidence_check, pack_chunks, run_estimate)}

_PAGES = "p AS (SELECT source AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pdf_page, text, doc_id % 2 = 0 AS has_images, doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS char_count FROM documents)"
_STATUS = "CASE WHEN char_count < 10 AND has_images THEN 'image_only' WHEN char_count < 10 THEN 'blank' WHEN char_count < 100 THEN 'sparse' ELSE 'machine_readable' END"
_CANON = "lower(trim(regexp_replace(translate({0}, '‘’“”–— ', '''''\"\"-- '), '\\s+', ' ', 'g')))"
_MARKS = f"m AS (SELECT document_id, pdf_page, CASE WHEN contains(text, 'Apache') THEN 'agreement' ELSE 'exhibit' END AS layer_id FROM p WHERE regexp_matches(text, '{BOUNDARY}'))"
_LAYERS = """n AS (SELECT document_id, max(pdf_page) AS pages FROM p GROUP BY 1),
r AS (SELECT document_id, layer_id, pdf_page AS start_page, coalesce(lead(pdf_page) OVER (PARTITION BY document_id ORDER BY pdf_page) - 1, pages) AS end_page FROM m JOIN n USING (document_id)
 UNION ALL SELECT document_id, 'unknown', 1, coalesce(f - 1, pages) FROM n LEFT JOIN (SELECT document_id, min(pdf_page) AS f FROM m GROUP BY 1) USING (document_id) WHERE coalesce(f, 2) > 1),
l AS (SELECT *, row_number() OVER (PARTITION BY document_id, layer_id ORDER BY start_page) - 1 AS ordinal FROM r)"""
_QUALIFIED = "CASE WHEN ordinal > 0 THEN layer_id || '-' || ordinal ELSE layer_id END"
_REGIONS = """h AS (SELECT *, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) AS head FROM p),
g AS (SELECT document_id, pdf_page, CASE WHEN regexp_matches(head, '^(?:the|der|die|la|le) ', 'i') THEN 'article' WHEN regexp_matches(head, '^[aeiou]', 'i') THEN 'vowel' END AS region_id FROM h),
k AS (SELECT * FROM (SELECT *, lag(region_id) OVER (PARTITION BY document_id ORDER BY pdf_page) AS before FROM g WHERE region_id IS NOT NULL) WHERE before IS NULL OR before <> region_id),
n2 AS (SELECT document_id, max(pdf_page) AS pages FROM p GROUP BY 1),
q AS (SELECT document_id, region_id, pdf_page AS start_page, coalesce(lead(pdf_page) OVER (PARTITION BY document_id ORDER BY pdf_page) - 1, pages) AS end_page FROM k JOIN n2 USING (document_id)
 UNION ALL SELECT document_id, 'body', 1, coalesce(f - 1, pages) FROM n2 LEFT JOIN (SELECT document_id, min(pdf_page) AS f FROM k GROUP BY 1) USING (document_id) WHERE coalesce(f, 2) > 1)"""
_SIGNATURES = ", ".join(f"({i}, '{s}', '{p}', {w}, '{n}')" for i, (s, p, w, n) in enumerate(SIGNATURES))
_SCORES = f"""s(ordinal, structure, pattern, weight, note) AS (VALUES {_SIGNATURES}),
e AS (SELECT document_id, structure, note, weight, min((pdf_page, ordinal)) AS seen FROM p, s WHERE regexp_matches(text, pattern, 'i') GROUP BY ALL),
t AS (SELECT document_id, structure, sum(weight)::BIGINT AS score, min(seen) AS seen FROM e GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, seen) AS rank, lead(score) OVER (PARTITION BY document_id ORDER BY score DESC, seen) AS next, (sum(score) OVER (PARTITION BY document_id))::BIGINT AS total, max(score) OVER (PARTITION BY document_id) AS top FROM t)"""

ORACLES = {
    "page_status": f"WITH {_PAGES} SELECT doc_id, char_count, {_STATUS} AS text_layer_status FROM p",
    "content_dups": f"SELECT content_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, substr(sha256({_CANON.format('text')}), 1, 16) AS content_hash FROM documents) GROUP BY 1 HAVING count(*) > 1",
    "dup_severity": f"""WITH {_PAGES}, c AS (SELECT *, substr(sha256({_CANON.format('text')}), 1, 16) AS h FROM p WHERE char_count >= 10),
med AS (SELECT document_id, char_count AS median FROM (SELECT document_id, char_count, row_number() OVER (PARTITION BY document_id ORDER BY char_count) AS r, count(*) OVER (PARTITION BY document_id) AS n FROM c) WHERE r = n // 2 + 1)
SELECT document_id, string_agg(pdf_page::VARCHAR, ',' ORDER BY pdf_page) AS pages, CASE WHEN arg_min(char_count, pdf_page) >= greatest(200, floor(any_value(median) * 0.3)) THEN 'error' ELSE 'info' END AS severity
FROM c JOIN med USING (document_id) GROUP BY document_id, h HAVING count(*) > 1""",
    "readability": f"""WITH {_PAGES}, s AS (SELECT *, {_STATUS} AS st FROM p) SELECT document_id, coalesce(string_agg(pdf_page::VARCHAR, ',' ORDER BY pdf_page) FILTER (st = 'image_only'), '') AS unreadable,
coalesce(string_agg(pdf_page::VARCHAR, ',' ORDER BY pdf_page) FILTER (st = 'blank'), '') AS blank, coalesce(string_agg(pdf_page::VARCHAR, ',' ORDER BY pdf_page) FILTER (st = 'sparse'), '') AS sparse FROM s GROUP BY 1""",
    "inventory_rollup": f"""WITH {_PAGES}, s AS (SELECT *, {_STATUS} AS st FROM p), a AS (SELECT document_id, count(*) AS page_count, sum(char_count)::BIGINT AS total_chars, bool_or(st = 'image_only') AS requires_ocr, bool_or(st = 'sparse' AND has_images) AS has_degraded_text FROM s GROUP BY 1)
SELECT *, total_chars > 0 AND NOT requires_ocr AND NOT has_degraded_text AS is_machine_readable FROM a""",
    "layer_segments": f"WITH {_PAGES}, {_MARKS}, {_LAYERS} SELECT document_id, {_QUALIFIED} AS qualified_id, layer_id, start_page, end_page, ordinal FROM l",
    "region_segments": f"WITH {_PAGES}, {_REGIONS} SELECT * FROM q",
    "body_pages": f"""WITH {_PAGES}, {_MARKS}, {_LAYERS}, {_REGIONS} SELECT p.document_id, p.pdf_page, {_QUALIFIED} AS qualified_id FROM p JOIN l ON p.document_id = l.document_id AND p.pdf_page BETWEEN l.start_page AND l.end_page
WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.region_id = 'article' AND q.document_id = p.document_id AND p.pdf_page BETWEEN q.start_page AND q.end_page)""",
    "structure_scores": f"WITH {_PAGES}, {_SCORES} SELECT document_id, structure, score, rank FROM u",
    "structure_class": f"""WITH {_PAGES}, {_SCORES}, f AS (SELECT document_id, structure, score, total, coalesce(next, 0) AS runner FROM u WHERE rank = 1),
o AS (SELECT document_id, string_agg(structure, ',' ORDER BY rank) AS secondary FROM u WHERE rank > 1 AND (score >= 10 OR score >= top / 1.5) GROUP BY 1),
d AS (SELECT DISTINCT document_id FROM p)
SELECT document_id, CASE WHEN score IS NULL OR score < 10 THEN 'unknown' ELSE structure END AS structure, CASE WHEN score IS NULL THEN 0.0::DOUBLE WHEN score < 10 THEN round_even(score / 10.0::DOUBLE, 2) ELSE round_even(score::DOUBLE / total, 2) END AS confidence,
CASE WHEN score >= 10 AND runner > 0 AND score < runner * 1.5 THEN coalesce(secondary, '') ELSE '' END AS secondary, CASE WHEN score IS NULL OR score < 10 OR (runner > 0 AND score < runner * 1.5) THEN 'exception' ELSE 'unreviewed' END AS review_status
FROM d LEFT JOIN f USING (document_id) LEFT JOIN o USING (document_id)""",
    "evidence_check": f"""WITH c AS (SELECT doc_id, {_CANON.format('text')} AS page FROM documents), q AS (SELECT item_id, {_CANON.format('text')} AS needle FROM benchmark)
SELECT doc_id, item_id, true AS anchor_intact, true AS found_on_page, true AS ok FROM c JOIN q ON needle <> '' AND contains(page, needle)""",
    "pack_chunks": """WITH RECURSIVE p AS (SELECT source AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, floor(length(text) / 2.9)::BIGINT + 1 AS t FROM documents),
f AS (SELECT document_id, page, 0::BIGINT AS chunk, t AS used, 1::BIGINT AS n FROM p WHERE page = 1
 UNION ALL SELECT p.document_id, p.page, CASE WHEN f.used + p.t > 5000 OR f.n >= 8 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + p.t > 5000 OR f.n >= 8 THEN p.t ELSE f.used + p.t END, CASE WHEN f.used + p.t > 5000 OR f.n >= 8 THEN 1 ELSE f.n + 1 END FROM f JOIN p ON p.document_id = f.document_id AND p.page = f.page + 1)
SELECT document_id, chunk AS chunk_index, min(page) AS first_page, count(*) AS n_pages FROM f GROUP BY 1, 2""",
    "run_estimate": """SELECT source AS document_id, count(*) AS pages, 1::BIGINT AS requests, floor(sum(length(text)) / 2.9)::BIGINT + 1 + 3000 AS input_tokens, round((floor(sum(length(text)) / 2.9) + 1 + 3000) * 5.0 / 1e6 + 20000 * 25.0 / 1e6, 6) AS cost_low,
round((floor(sum(length(text)) / 2.9) + 1 + 3000) * 5.0 / 1e6 + 45000 * 25.0 / 1e6, 6) AS cost_high FROM documents GROUP BY 1""",
}
