"""Printed page labels: reading them off a page, and their series and ordinal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import lines

# fixed values: label patterns, most specific first
SERIES_LABEL = r"^[\s\[\(]*([A-Z]{1,3})[\-–](\d{1,4})[\s\]\)]*$"
NUMBER_LABEL = r"^[\-–—\s\[\(]*(\d{1,4})[\-–—\s\]\)]*$"
ROMAN_LABEL = r"^[\-–—\s\[\(]*([ivxlcdmIVXLCDM]{1,7})[\-–—\s\]\)]*$"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _label_on(line: Column) -> Column:
    """The label that one edge line holds; a bare four-digit number is a year."""
    number = F.regexp_extract(line, NUMBER_LABEL, 1)
    return (
        F.when(line.rlike(SERIES_LABEL), F.concat_ws("-", F.regexp_extract(line, SERIES_LABEL, 1), F.regexp_extract(line, SERIES_LABEL, 2)))
        .when((number != "") & (F.length(number) < 4), number)
        .when((number == "") & line.rlike(ROMAN_LABEL), F.regexp_extract(line, ROMAN_LABEL, 1))
    )


def printed_label(text: Column) -> Column:
    """Label among the last three lines, from below, or the first two."""
    every = lines(text)
    n = F.size(every)
    low = F.reverse(F.slice(every, F.greatest(n - 2, F.lit(1)), F.lit(3)))
    edge = F.concat(low, F.slice(every, 1, 2))
    return F.get(F.filter(F.transform(edge, _label_on), lambda x: x.isNotNull()), F.lit(0))


def _roman(label: Column) -> Column:
    """Value of a roman numeral, read from its end."""
    digit = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    signs = F.reverse(F.filter(F.split(F.lower(label), ""), lambda c: c != ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))

    def step(a: Column, c: Column) -> Column:
        v = F.try_element_at(digit, c)
        return F.struct((a["total"] + F.when(v >= a["top"], v).otherwise(-v)).alias("total"), F.greatest(a["top"], v).alias("top"))

    return F.aggregate(signs, start, step, lambda a: a["total"])


def parse_label(label: Column) -> Column:
    """(series, ordinal): plain numbers, roman numerals or a lettered series; else null."""
    series = r"^([A-Za-z]+)-(\d+)$"
    out = lambda s, n: F.struct(s.alias("series"), n.alias("ordinal"))
    return (
        F.when(label.rlike(r"^\d+$"), out(F.lit(""), label.try_cast("int")))
        .when(label.rlike(r"^[ivxlcdmIVXLCDM]{1,7}$"), out(F.lit("roman"), _roman(F.regexp_extract(label, r"^([ivxlcdmIVXLCDM]{1,7})$", 1))))
        .when(label.rlike(series), out(F.upper(F.regexp_extract(label, series, 1)), F.regexp_extract(label, series, 2).try_cast("int")))
    )
