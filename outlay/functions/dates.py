"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay.functions.text import strip

# Formats in the order in which they are tried, then those of the free-form fall-back (day first).
FORMATS = ("d/M/yyyy", "yyyy-M-d", "d-MMM-yyyy", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d")
FREE_FORMATS = ("MMMM d yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d.M.yyyy", "d-MMMM-yyyy", "yyyyMMdd")


def _tried(text: Column) -> Column:
    """The first format that fits. Only those are tried that have the text's separators, and names of months or not: no other can fit."""
    plain = F.initcap(F.lower(F.regexp_replace(text, r"\s+", " ")))
    named = text.rlike("[A-Za-z]")

    def tries(*separators: str) -> list[Column]:
        fitting = [f for f in FORMATS + FREE_FORMATS if any(s in f if s else not set(f) & set("/.- ") for s in separators)]
        names, numbers = ([F.try_to_date(plain if month else text, f) for f in fitting if ("MMM" in f) == month] for month in (True, False))
        return [*([F.when(named, F.coalesce(*names))] if names else []), *([F.when(~named, F.coalesce(*numbers))] if numbers else [])]

    # eight digits are a date, fewer are a day number
    serial = F.when(text.rlike(r"^\d{1,6}(\.\d+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(text.try_cast("double")).cast("int")))
    # a number may have a sign, so that only a text without other separators is told by its dashes
    return F.when(text.contains("/"), F.coalesce(*tries("/"))).when(text.contains("."), F.coalesce(*tries("."), serial)).when(text.rlike(r"\s"), F.coalesce(*tries(" "))).otherwise(F.coalesce(*tries("-", ""), serial))


def parse_date(c: Column) -> Column:
    """A date in any of the known formats, or a spreadsheet's day number; null for anything else.

    A loop over the one text, so that it is worked out once and the program of a row stays short enough to be compiled.
    """
    text = strip(c)
    return F.get(F.transform(F.array(F.when(~text.isin("", "N/A"), text)), _tried), F.lit(0))


def month_ordinal(c: Column) -> Column:
    """Months since year 0 of a date or a text that begins with yyyy-MM."""
    text = F.substring(c.cast("string"), 1, 7)
    return F.substring(text, 1, 4).try_cast("int") * 12 + F.substring(text, 6, 2).try_cast("int")


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def quarter(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string")))
