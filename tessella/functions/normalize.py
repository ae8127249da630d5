"""Typed normalization of raw readings.

Every function returns one struct: the typed value (number, text or boolean), a
status (ok, ambiguous, unparseable, empty), a reason and a qualifier.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import collapse

# fixed values: vocabularies; their order is part of the meaning
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "mm": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12}
CURRENCIES = (
    ("$", "USD"), ("us$", "USD"), ("usd", "USD"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP"), ("¥", "JPY"), ("jpy", "JPY"),
    ("chf", "CHF"), ("c$", "CAD"), ("cad", "CAD"), ("a$", "AUD"), ("aud", "AUD"), ("sek", "SEK"), ("dkk", "DKK"), ("nok", "NOK"),
)
FRACTIONS = (("a majority", 0.5), ("majority", 0.5), ("two-thirds", 2 / 3), ("two thirds", 2 / 3), ("three-quarters", 0.75), ("three quarters", 0.75), ("nine-tenths", 0.9))
DATE_FORMATS = ("yyyy-M-d", "MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMM yyyy", "M/d/yyyy")
QUALIFIER = r"(?iU)\b(approximately|approx\.?|about|around|up\s+to|not\s+(?:to\s+)?exceed(?:ing)?|no\s+more\s+than|at\s+least|in\s+excess\s+of|estimated)\b"
BOUND = r"(?iU)\b(up\s+to|not\s+(?:to\s+)?exceed|no\s+more\s+than|at\s+least|in\s+excess\s+of)\b"
AMOUNT = r"(?iU)(-?\d[\d,]*\.?\d*)\s*(thousand|million|billion|trillion|mm|bn|[kmb])?\b"
RELATIVE = (
    r"(?iU)\b(anniversary|business\s+days?\s+(?:after|following|from)|days?\s+(?:after|following|from)|months?\s+(?:after|following|from)"
    r"|promptly|as\s+soon\s+as|upon\s+(?:the\s+)?|following\s+the|after\s+the\s+date\s+hereof|date\s+hereof)\b"
)
EMBEDDED_DATE = r"([A-Z][a-z]+\.?\s+\d{1,2},?\s+\d{4})"
PERCENT = r"(\d+(?:\.\d+)?)\s*(?:%|percent|per\s+cent)"

OK, AMBIGUOUS, UNPARSEABLE, EMPTY = "ok", "ambiguous", "unparseable", "empty"


def _is_blank(raw: Column) -> Column:
    return raw.isNull() | (collapse(raw) == "")


def outcome(status, *, num: Column | None = None, text: Column | None = None, flag: Column | None = None, reason=None, qualifier: Column | None = None) -> Column:
    """One result struct; parts that are not given are null."""
    as_col = lambda x, kind: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(
        as_col(num, "double").alias("value_num"),
        as_col(text, "string").alias("value_text"),
        as_col(flag, "boolean").alias("value_bool"),
        as_col(status, "string").alias("status"),
        as_col(reason, "string").alias("reason"),
        as_col(qualifier, "string").alias("qualifier"),
    )


def _empty(raw: Column, rest: Column) -> Column:
    return F.when(_is_blank(raw), outcome(EMPTY, reason="no value")).otherwise(rest)


def money(raw: Column) -> Column:
    """First amount with its scale word. A stated bound keeps its figure but is ambiguous."""
    text = collapse(raw)
    digits, scale = F.regexp_extract(text, AMOUNT, 1), F.lower(F.regexp_extract(text, AMOUNT, 2))
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SCALES.items() for x in p]), scale), F.lit(1.0))
    amount = F.replace(digits, F.lit(","), F.lit("")).try_cast("double") * factor
    said = F.lower(F.regexp_extract(text, QUALIFIER, 0))
    qualifier = F.when(said != "", said)
    return _empty(
        raw,
        F.when(amount.isNull(), outcome(UNPARSEABLE, reason="no amount"))
        .when(qualifier.rlike(BOUND), outcome(AMBIGUOUS, num=amount, reason="stated as a bound, not as an amount", qualifier=qualifier))
        .otherwise(outcome(OK, num=amount, qualifier=qualifier)),
    )


def currency(raw: Column) -> Column:
    """ISO code: an exact code, else the first known sign or code that the text holds."""
    text = F.lower(collapse(raw))
    codes = sorted({c.lower() for _, c in CURRENCIES})
    code = F.when(text.isin(codes), F.upper(text))
    for sign, iso in CURRENCIES:
        code = F.coalesce(code, F.when(F.contains(text, F.lit(sign)), F.lit(iso)))
    return _empty(raw, F.when(code.isNull(), outcome(UNPARSEABLE, reason="unknown currency")).otherwise(outcome(OK, text=code)))


def _shape(date_format: str) -> str:
    """A pattern that every text of a date format matches."""
    return "^" + re.sub("y+|M+|d+", lambda m: r"[+-]?\d+" if m[0][0] == "y" or len(m[0]) < 3 else r"\D+", date_format) + "$"


def _parse_date(text: Column) -> Column:
    """ISO text of a date in one of the known formats."""
    bare = F.regexp_replace(text, r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    spaced = collapse(F.replace(bare, F.lit(","), F.lit(", ")))
    forms = F.array(spaced, F.replace(spaced, F.lit(", "), F.lit(" ")))
    # a lambda, so that the text is prepared once and not once per format; a parse that fails
    # costs far more than a pattern, so a format is tried on texts of its shape only
    parsed = F.transform(forms, lambda c: F.coalesce(*[F.when(c.rlike(_shape(f)), F.try_to_date(c, f)) for f in DATE_FORMATS]))
    return F.date_format(F.get(F.filter(parsed, lambda d: d.isNotNull()), F.lit(0)), "yyyy-MM-dd")


def date(raw: Column) -> Column:
    """Calendar date as ISO text; dates told by other events are ambiguous."""
    text = collapse(raw)
    plain = _parse_date(text)
    inner = F.regexp_extract(text, EMBEDDED_DATE, 1)
    nested = _parse_date(F.when(inner != "", inner))
    return _empty(
        raw,
        F.when(text.rlike(RELATIVE), outcome(AMBIGUOUS, reason="told relative to another event"))
        .when(plain.isNotNull(), outcome(OK, text=plain))
        .when(nested.isNotNull(), outcome(OK, text=nested, reason="date inside a longer phrase"))
        .otherwise(outcome(UNPARSEABLE, reason="no date")),
    )


def percent(raw: Column) -> Column:
    """A share from 0 to 1: numeric, or one of the usual fractions in words."""
    text = F.lower(collapse(raw))
    n = F.regexp_extract(text, PERCENT, 1).try_cast("double") / 100.0
    worded = F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(v)) for w, v in FRACTIONS])
    return _empty(
        raw,
        F.when(n.isNotNull(), outcome(OK, num=n)).when(worded.isNotNull(), outcome(OK, num=worded, reason="told in words")).otherwise(outcome(AMBIGUOUS, reason="no numeric share")),
    )


def _slug(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_-]+", "_")


def enum(raw: Column, allowed: Column) -> Column:
    """Member of a closed vocabulary, whatever the case and the separators."""
    hit = F.get(F.filter(allowed, lambda a: _slug(a) == _slug(raw)), F.lit(0))
    return _empty(raw, F.when(hit.isNotNull(), outcome(OK, text=hit)).otherwise(outcome(AMBIGUOUS, reason="not in the vocabulary")))


def boolean(raw: Column) -> Column:
    text = F.lower(collapse(raw))
    flag = F.when(text.isin("yes", "true", "y"), F.lit(True)).when(text.isin("no", "false", "n", "none"), F.lit(False))
    return _empty(raw, F.when(flag.isNull(), outcome(AMBIGUOUS, reason="neither yes nor no")).otherwise(outcome(OK, flag=flag)))


def text(raw: Column) -> Column:
    return _empty(raw, outcome(OK, text=collapse(raw)))


def by_kind(field_name: Column, kind: Column, allowed: Column, raw: Column) -> Column:
    """The normalizer of a field: by its name for currencies, else by its type."""
    known = kind.isin("money", "date", "percent", "boolean", "enum", "text")
    return (
        F.when(kind.isNull() | ~known, outcome(UNPARSEABLE, reason="unknown type"))
        .when(field_name.endswith("_currency"), currency(raw))
        .when(kind == "money", money(raw))
        .when(kind == "date", date(raw))
        .when(kind == "percent", percent(raw))
        .when(kind == "boolean", boolean(raw))
        .when(kind == "enum", enum(raw, allowed))
        .otherwise(text(raw))
    )


EMBEDDED_MONEY = r"(?iU)(?:[$€£¥]|\b(?:USD|EUR|GBP|JPY|CHF)\b)\s*(\d[\d,.]*)\s*(billion|million|bn|mm|m|b)?"
STRICT_MONEY = EMBEDDED_MONEY.replace("|m|b)?", r"|m|b)?(?![\p{L}\d])")


def embedded_amounts(x: Column, whole_words: bool = False) -> Column:
    """Distinct amounts with a currency inside prose, sorted.

    ``whole_words`` refuses scale letters that begin another word ("$250
    monthly"); the default reads them as scales.
    """
    x = F.coalesce(x, F.lit(""))
    pattern = F.lit(STRICT_MONEY if whole_words else EMBEDDED_MONEY)
    scale = F.create_map(*[F.lit(v) for p in (("billion", 1e9), ("bn", 1e9), ("b", 1e9), ("million", 1e6), ("mm", 1e6), ("m", 1e6)) for v in p])
    both = F.arrays_zip(F.regexp_extract_all(x, pattern, F.lit(1)).alias("d"), F.regexp_extract_all(x, pattern, F.lit(2)).alias("s"))
    value = lambda z: F.replace(z["d"], F.lit(","), F.lit("")).try_cast("double") * F.coalesce(F.try_element_at(scale, F.lower(z["s"])), F.lit(1.0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(both, value), lambda v: v.isNotNull())))
