"""Readings of clause language: extensions, their kind, and maturities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import blank_to_null

# fixed values: patterns and day counts
DURATION = r"(?iU)(?:\((\d+)\)|\b(\d+))[-\s]*(day|business\s+day|week|month)s?\b"
COUNT = (
    r"(?iU)\b(?:(one|two|three|four|\d+)\s+(?:(?:successive|additional|separate|further|consecutive)\s+)?"
    r"(?:\d+[-\s]*(?:business\s+)?(?:day|week|month)s?\s+)?(?:periods?|extensions?|occasions?|times?)|(twice))\b"
)
AUTOMATIC = r"(?iU)\b(automatic(?:ally)?|shall\s+be\s+extended|without\s+further\s+action)\b"
ELECTIVE = r"(?iU)\b(may\s+(?:be\s+)?(?:elect|extend)|at\s+(?:the\s+)?(?:option|election)|either\s+party\s+may)\b"
DAYS = {"day": 1, "business day": 1, "week": 7, "month": 30}
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4}
TENOR = r"(?iU)(\d[\d,.]*)\s*[-\s]*(day|week|month|year)s?"
YEARS = {"day": 1 / 365.0, "week": 7 / 365.0, "month": 1 / 12.0, "year": 1.0}
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), key)


def extension(text: Column) -> Column:
    """(count, amount, unit) of an extension clause; null where it cannot be read."""
    digits = F.coalesce(blank_to_null(F.regexp_extract(text, DURATION, 1)), blank_to_null(F.regexp_extract(text, DURATION, 2)))
    amount = digits.try_cast("int")
    unit = F.lower(F.regexp_replace(F.regexp_extract(text, DURATION, 3), r"(?U)\s+", " "))
    word = F.lower(F.regexp_extract(text, COUNT, 1))
    said = F.coalesce(_lookup(NUMBERS, word), word.try_cast("int"))
    count = F.when(F.regexp_extract(text, COUNT, 2) != "", 2).otherwise(F.greatest(F.coalesce(said, F.lit(1)), F.lit(1)))
    good = (amount > 0) & _lookup(DAYS, unit).isNotNull()
    return F.when(good, F.struct(count.cast("int").alias("count"), amount.alias("amount"), unit.alias("unit")))


def step_days(parsed: Column) -> Column:
    """Days of one extension step; months count 30, business days 1."""
    return parsed["amount"] * _lookup(DAYS, parsed["unit"])


def extension_kind(text: Column, default: str = "party_election") -> Column:
    x = F.coalesce(text, F.lit(""))
    return F.when(x.rlike(AUTOMATIC) & ~x.rlike(ELECTIVE), "automatically_extended").when(x.rlike(ELECTIVE), "party_election").otherwise(default)


def tenor_years(text: Column) -> Column:
    """First stated length in years; null if there is none or it is not positive."""
    n = F.replace(F.regexp_extract(text, TENOR, 1), F.lit(","), F.lit("")).try_cast("double")
    return F.when(n > 0, n * _lookup(YEARS, F.lower(F.regexp_extract(text, TENOR, 2))))
