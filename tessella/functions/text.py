"""Canonical text, hashes, locators, citations and evidence checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "src://"
ANCHOR_LENGTH = 16
LOCATOR = r"^src://([^/]+)/([^/]+)/pdf:(\d+)(?:/doc:([^#]*))?(?:#([0-9a-f]+))?$"


def blank_to_null(x: Column) -> Column:
    """Empty and null text mean the same at the edge of the engine."""
    return F.when(F.length(x) > 0, x)


def collapse(x: Column) -> Column:
    """Runs of Unicode white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def fold_case(x: Column) -> Column:
    """Lower case with sharp s opened, the part of case folding that filings need."""
    return F.lower(F.replace(x, F.lit("ß"), F.lit("ss")))


def nfkc(x: Column) -> Column:
    """Compatibility composition; only texts beyond ASCII leave the JVM."""

    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(compose(F.when(~x.rlike(r"^\p{ASCII}*$"), x)), x)


def canonical(x: Column, compose: bool = True) -> Column:
    """The form in which texts are hashed and searched; empty for null.

    ``compose=False`` leaves out NFKC where the input is known to be composed,
    which keeps the whole expression in the JVM.
    """
    x = F.coalesce(x, F.lit(""))
    x = nfkc(x) if compose else x
    x = F.translate(x, "‘’“”–— ", "''\"\"-- ")
    return F.lower(collapse(x))


def anchor(x: Column, compose: bool = True) -> Column:
    """Short hash of the canonical text; null for an empty one."""
    c = canonical(x, compose)
    return F.when(c != "", F.substring(F.sha2(c, 256), 1, ANCHOR_LENGTH))


def content_hash(x: Column, compose: bool = True) -> Column:
    """Like ``anchor``, but empty text hashes too."""
    return F.substring(F.sha2(canonical(x, compose), 256), 1, ANCHOR_LENGTH)


def document_id(checksum: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(checksum, 1, 12))


def locator_uri(document: Column, layer: Column, page: Column, label: Column, mark: Column) -> Column:
    """Locator of a place; label and anchor only where they are not empty."""
    tail = [F.when(F.length(label) > 0, F.concat(F.lit("/doc:"), label)), F.when(F.length(mark) > 0, F.concat(F.lit("#"), mark))]
    return F.concat(F.lit(SCHEME), document, F.lit("/"), layer, F.lit("/pdf:"), page.cast("string"), *[F.coalesce(t, F.lit("")) for t in tail])


def parse_locator(uri: Column, strict: bool = False) -> Column:
    """The parts of a locator; null, or an error in strict mode, for anything else."""
    part = lambda i: F.regexp_extract(uri, LOCATOR, i)
    parts = F.struct(
        part(1).alias("document_id"),
        part(2).alias("layer_id"),
        part(3).cast("int").alias("pdf_page"),
        blank_to_null(part(4)).alias("printed_page"),
        blank_to_null(part(5)).alias("anchor"),
    )
    good = uri.rlike(LOCATOR)
    if strict:
        return F.when(good, parts).when(uri.isNotNull(), F.raise_error(F.concat(F.lit("malformed locator: "), uri)))
    return F.when(good, parts)


def citation(layer: Column, section: Column, label: Column, page: Column) -> Column:
    """A readable reference: layer, section and page."""
    at = F.when(F.length(label) > 0, F.concat(F.lit("page "), label, F.lit(" (PDF page "), page.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("PDF page "), page.cast("string")))
    return F.concat_ws(", ", F.replace(layer, F.lit("-"), F.lit(" ")), blank_to_null(section), at)


def evidence(quote: Column, stored_anchor: Column, page_text: Column, compose: bool = True) -> Column:
    """Two separate tests of a quote: its anchor is intact, and its page holds it.

    A missing quote or anchor fails; so does an empty page.
    """
    has = F.length(F.coalesce(quote, F.lit(""))) > 0
    intact = F.coalesce(has & (anchor(quote, compose) == stored_anchor), F.lit(False))
    needle, page = canonical(quote, compose), canonical(page_text, compose)
    found = has & (needle != "") & (page != "") & F.contains(page, needle)
    reason = F.when(~has, F.lit("no evidence quote")).when(~intact & ~found, F.lit("anchor differs and quote is not on the cited page")).when(~found, F.lit("quote is not on the cited page")).when(~intact, F.lit("anchor differs from the quote"))
    return F.struct(intact.alias("anchor_intact"), found.alias("found_on_page"), (intact & found).alias("ok"), reason.alias("reason"))


def page_head(x: Column, size: int = 400) -> Column:
    return F.substring(collapse(F.coalesce(x, F.lit(""))), 1, size)


def lines(x: Column) -> Column:
    """Stripped lines that are not blank."""
    cut = F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(cut, lambda s: s != "")


def number_text(x: Column) -> Column:
    """A double as text, whole numbers without exponent."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e16)
    return F.when(whole, F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def clipped(x: Column, limit: int = 32_000) -> Column:
    """A cell for a spreadsheet: long text is cut and says how long it was."""
    note = F.concat(F.lit(" … ["), F.format_number(F.length(x), 0), F.lit(" characters]"))
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), note)).otherwise(x)
