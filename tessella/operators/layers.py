"""Segmentation of a filing into layers and regions, and page lookups in them.

Layers and regions are range tables. They are small next to the pages, but the
joins leave it to Catalyst, with document equality as the key, how to run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import dims
from tessella.functions.text import anchor, lines, locator_uri, page_head

LABEL_LINES, LABEL_WORDS = 5, 6
LAYER_HEAD, REGION_HEAD = 400, 200
CONTENTS_PAGES, CONTENTS_LINES = 6, 5


def exhibit_label(text: Column) -> Column:
    """Upper-case exhibit number on a short line among the first ones; else null."""
    first = F.slice(lines(text), 1, LABEL_LINES)
    short = F.filter(first, lambda s: (F.size(F.split(s, r"(?U)\s+")) <= LABEL_WORDS) & s.rlike("(?iU)" + dims.EXHIBIT_COVER))
    return F.upper(F.regexp_extract(F.get(short, F.lit(0)), "(?iU)" + dims.EXHIBIT_COVER, 1))


def first_signature(head: Column, signatures: Sequence[tuple[str, str, str]]) -> Column:
    """(id, label) of the first pattern that matches; null for none."""
    out = F.lit(None).cast("struct<id:string,label:string>")
    for name, pattern, label in reversed(signatures):
        out = F.when(head.rlike("(?iU)" + pattern), F.struct(F.lit(name).alias("id"), F.lit(label).alias("label"))).otherwise(out)
    return out


def boundaries(pages: DataFrame, instruments=dims.INSTRUMENTS, cover: str = dims.SEC_COVER) -> DataFrame:
    """Pages on which a layer begins: the first cover, and exhibit covers."""
    head = page_head(F.col("text"), LAYER_HEAD)
    sec = "(?isU)" + cover
    marks = pages.select("document_id", "pdf_page", head.alias("head"), exhibit_label(F.col("text")).alias("exhibit_number"), F.regexp_extract(head, sec, 0).alias("cover")).where("head <> ''")
    marks = marks.withColumn("is_cover", F.col("cover") != "")
    marks = marks.where(F.col("is_cover") | F.col("exhibit_number").isNotNull())
    # a cover opens the summary only where nothing began before it; later covers count as exhibits if labelled
    first = F.min("pdf_page").over(Window.partitionBy("document_id"))
    marks = marks.withColumn("opens", F.col("is_cover") & (F.col("pdf_page") == first))
    marks = marks.where(F.col("opens") | F.col("exhibit_number").isNotNull())
    found = first_signature(F.col("head"), instruments)
    return marks.select(
        "document_id",
        "pdf_page",
        F.when(F.col("opens"), "filing-summary").otherwise(F.coalesce(found["id"], F.lit("exhibit"))).alias("layer_id"),
        F.when(~F.col("opens"), F.col("exhibit_number")).alias("exhibit_number"),
        F.when(F.col("opens"), F.substring("cover", 1, 120)).otherwise(F.concat(F.lit("Exhibit "), F.col("exhibit_number"), F.lit(": "), F.coalesce(found["label"], F.lit("Unidentified exhibit")))).alias("evidence"),
    )


def segment_layers(pages: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Layer ranges; every page of every document lies in exactly one.

    ``marks`` (document_id, pdf_page, layer_id, exhibit_number, evidence) may come
    from other boundary rules.
    """
    marks = boundaries(pages) if marks is None else marks
    counts = pages.groupBy("document_id").agg(F.max("pdf_page").alias("page_count"))
    w = Window.partitionBy("document_id").orderBy("pdf_page")
    ranges = marks.join(counts, "document_id").select(
        "document_id",
        "layer_id",
        "exhibit_number",
        F.col("pdf_page").alias("start_page"),
        F.coalesce(F.lead("pdf_page").over(w) - 1, F.col("page_count")).alias("end_page"),
        F.lit("signature").alias("detection_method"),
        "evidence",
    )
    opened = marks.groupBy("document_id").agg(F.min("pdf_page").alias("first_mark"))
    rest = counts.join(opened, "document_id", "left").where(F.coalesce("first_mark", F.lit(2)) > 1)
    front = rest.select(
        "document_id",
        F.lit("unknown").alias("layer_id"),
        F.lit(None).cast("string").alias("exhibit_number"),
        F.lit(1).alias("start_page"),
        F.coalesce(F.col("first_mark") - 1, F.col("page_count")).alias("end_page"),
        F.lit("fallback").alias("detection_method"),
        F.lit(None).cast("string").alias("evidence"),
    )
    every = ranges.unionByName(front)
    nth = F.row_number().over(Window.partitionBy("document_id", "layer_id").orderBy("start_page")) - 1
    every = every.withColumn("ordinal", nth)
    label = F.create_map(*[F.lit(x) for p in dims.LAYER_LABELS.items() for x in p])
    qualified = F.when(F.length("exhibit_number") > 0, F.concat("layer_id", F.lit("-ex"), F.lower("exhibit_number"))).when(F.col("ordinal") > 0, F.concat("layer_id", F.lit("-"), F.col("ordinal").cast("string"))).otherwise(F.col("layer_id"))
    return every.withColumns({"label": F.coalesce(F.try_element_at(label, F.col("layer_id")), F.lit("Exhibit")), "qualified_id": qualified})


def pages_in(pages: DataFrame, ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pages joined to the ranges that hold them, within a document."""
    r = ranges.select(F.col("document_id").alias("_doc"), F.col("start_page").alias("_start"), F.col("end_page").alias("_end"), *columns)
    on = (F.col("document_id") == F.col("_doc")) & F.col("pdf_page").between(F.col("_start"), F.col("_end"))
    return pages.join(r, on, "left").drop("_doc", "_start", "_end")


def segment_regions(pages: DataFrame, layers: DataFrame, signatures=dims.REGIONS) -> DataFrame:
    """Regions of each layer; what no mark claims is body.

    A mark equal to the one before it is a running header. Where a table of
    contents runs over many pages, its dense head stays and the rest is body.
    """
    base = layers.select("document_id", "qualified_id", "start_page", "end_page")
    inside = pages_in(pages.select("document_id", "pdf_page", "text"), layers, ["qualified_id", F.col("start_page").alias("layer_start"), F.col("end_page").alias("layer_end")])
    found = inside.withColumn("m", first_signature(page_head(F.col("text"), REGION_HEAD), signatures)).where("m is not null")
    w = Window.partitionBy("document_id", "qualified_id").orderBy("pdf_page")
    marks = found.withColumn("before", F.lag("m.id").over(w)).where("before is null or before <> m.id")
    marked = marks.select(
        "document_id", "qualified_id", F.col("m.id").alias("region_id"), F.col("m.label").alias("label"), F.col("pdf_page").alias("start_page"), F.coalesce(F.lead("pdf_page").over(w) - 1, F.col("layer_end")).alias("end_page")
    )
    opened = marks.groupBy("document_id", "qualified_id").agg(F.min("pdf_page").alias("first_mark"))
    body = base.join(opened, ["document_id", "qualified_id"], "left").where("first_mark is null or first_mark > start_page")
    body = body.select("document_id", "qualified_id", F.lit("body").alias("region_id"), F.lit("Body").alias("label"), "start_page", F.coalesce(F.col("first_mark") - 1, F.col("end_page")).alias("end_page"))
    regions = marked.unionByName(body)

    long_toc = (F.col("region_id") == "table-of-contents") & (F.col("end_page") - F.col("start_page") + 1 > CONTENTS_PAGES)
    toc = regions.where(long_toc)
    dense = F.size(F.filter(lines(F.col("text")), lambda s: s.rlike(r"^\d+$"))) >= CONTENTS_LINES
    thin = pages_in(pages.select("document_id", "pdf_page", "text"), toc, ["qualified_id", F.col("start_page").alias("toc_start")]).where(F.col("qualified_id").isNotNull() & ~dense)
    ends = thin.groupBy("document_id", "qualified_id", F.col("toc_start").alias("start_page")).agg(F.min("pdf_page").alias("thin_page"))
    cut = toc.join(ends, ["document_id", "qualified_id", "start_page"], "left").withColumn("last", F.greatest(F.col("start_page"), F.coalesce(F.col("thin_page") - 1, F.col("end_page"))))
    head = cut.select("document_id", "qualified_id", "region_id", "label", "start_page", F.col("last").alias("end_page"))
    tail = cut.where("last < end_page").select("document_id", "qualified_id", F.lit("body").alias("region_id"), F.lit("Body").alias("label"), (F.col("last") + 1).alias("start_page"), "end_page")
    return regions.where(~long_toc).unionByName(head).unionByName(tail)


def body_pages(pages: DataFrame, layers: DataFrame, regions: DataFrame) -> DataFrame:
    """Pages of layers without tables of contents and term indexes."""
    skip = regions.where(F.col("region_id").isin("table-of-contents", "index-of-defined-terms"))
    r = skip.select(F.col("document_id").alias("_doc"), F.col("start_page").alias("_s"), F.col("end_page").alias("_e"))
    inside = pages_in(pages, layers, ["layer_id", "qualified_id"])
    return inside.join(r, (F.col("document_id") == F.col("_doc")) & F.col("pdf_page").between(F.col("_s"), F.col("_e")), "left_anti")


def pages_to_scan(pages: DataFrame, layers: DataFrame, regions: DataFrame) -> DataFrame:
    """Body pages of agreement layers where a document has one, else all its pages."""
    body = body_pages(pages, layers, regions).where("layer_id = 'agreement'").select(*pages.columns)
    with_one = layers.where("layer_id = 'agreement'").select("document_id").distinct()
    return body.unionByName(pages.join(with_one, "document_id", "left_anti").select(*pages.columns))


def unreadable_in_scope(pages: DataFrame, layers: DataFrame, regions: DataFrame, scope: Sequence[str] = dims.EXTRACTABLE_LAYERS) -> DataFrame:
    """Image-only body pages within the layers in scope."""
    return body_pages(pages, layers.where(F.col("layer_id").isin(list(scope))), regions).where("qualified_id is not null and text_layer_status = 'image_only'")


def layer_of_kind(layers: DataFrame, kind: str) -> DataFrame:
    """Each document's first layer of a kind."""
    return layers.where(F.col("layer_id") == kind).groupBy("document_id").agg(F.min_by("qualified_id", "start_page").alias("qualified_id"))


def with_locators(places: DataFrame, reconciled: DataFrame, layers: DataFrame, compose: bool = True) -> DataFrame:
    """Add layer, trusted label, anchor and locator to rows of (document_id, pdf_page, section, evidence)."""
    labels = reconciled.where("label_source = 'reconciled'").select("document_id", "pdf_page", "printed_page")
    out = pages_in(places, layers, [F.col("qualified_id").alias("_layer")]).join(labels, ["document_id", "pdf_page"], "left")
    mark = anchor(F.col("evidence"), compose)
    return out.withColumns(
        {"anchor": mark, "locator_uri": locator_uri(F.col("document_id"), F.coalesce("_layer", F.lit("unknown")), F.col("pdf_page"), F.col("printed_page"), mark)}
    ).withColumnRenamed("_layer", "page_layer")


def warnings(layers: DataFrame, structures: DataFrame) -> DataFrame:
    """Per document what ingestion has to warn of."""
    have = layers.groupBy("document_id").agg(F.bool_or(F.col("layer_id") == "agreement").alias("a"), F.bool_or(F.col("layer_id") == "filing-summary").alias("s"))
    listed = F.array(
        F.when(~F.col("a"), F.lit("no agreement layer")),
        F.when(~F.col("s"), F.lit("no summary layer")),
        F.when(F.coalesce("structure", F.lit("unknown")) == "unknown", F.lit("unknown structure")),
    )
    return have.join(structures.select("document_id", "structure"), "document_id", "left").select("document_id", F.array_compact(listed).alias("warnings"))
