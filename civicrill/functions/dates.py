"""Dates with precision, periods and freshness as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_period(day: Column, start: Column, end: Column) -> Column:
    """Both ends count; an unknown day is in no period."""
    return F.coalesce(day.between(start, end), F.lit(False))


def reasonable(day: Column, first_year: int, last_year: int) -> Column:
    """The day, or null (unknown) when its year cannot be right; the row itself stays."""
    return F.when(F.year(day).between(first_year, last_year), day)


def precision(text: Column) -> Column:
    """year, month or day, by the form of a partial ISO date; null for other texts."""
    return F.when(text.rlike("^[0-9]{4}$"), "year").when(text.rlike("^[0-9]{4}-[0-9]{2}$"), "month").when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "day")


def completed(text: Column) -> Column:
    """A partial date completed to a full one, for sorting only."""
    p = precision(text)
    return F.when(p == "year", F.concat(text, F.lit("-01-01"))).when(p == "month", F.concat(text, F.lit("-01"))).when(p == "day", text)


def months_apart(a: Column, b: Column) -> Column:
    """Calendar months between two days, days of the month ignored; 9999 when either is unknown."""
    return F.coalesce(F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)), F.lit(9999))


def days_class(gap: Column) -> Column:
    """Points for closeness in time: 26, 16, 6 or 0; null gap scores 0."""
    return F.when(gap.between(0, 120), 26).when(gap.between(0, 365), 16).when(gap.between(0, 730), 6).otherwise(0)


def freshness(newest: Column, as_of: Column, tolerance: int) -> Column:
    """missing, stale or ok."""
    return F.when(newest.isNull(), "missing").when(newest < F.date_sub(as_of, tolerance), "stale").otherwise("ok")


def active(last: Column, as_of: Column) -> Column:
    return last >= F.date_sub(as_of, 365)


def local_date(text: Column) -> Column:
    """The first d. m. yyyy in a text; null when there is none or it is no date."""
    g = [F.regexp_extract(text, "\\b([0-9]{1,2})\\. ?([0-9]{1,2})\\. ?([0-9]{4})\\b", i) for i in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", g[2], F.lpad(g[1], 2, "0"), F.lpad(g[0], 2, "0")), "yyyy-MM-dd")


def local_dates(text: Column) -> Column:
    """All dates d. m. yyyy in a text that exist, in the order of the text."""
    found = F.regexp_extract_all(text, F.lit("\\b[0-9]{1,2}\\. ?[0-9]{1,2}\\. ?[0-9]{4}\\b"), F.lit(0))
    return F.filter(F.transform(found, local_date), lambda d: d.isNotNull())


def compact_date(text: Column) -> Column:
    """yyyymmdd as a date, else null."""
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))


def seconds(time_code: Column) -> Column:
    """h:m:s or m:s as seconds."""
    parts = F.reverse(F.transform(F.split(time_code, ":"), lambda x: x.try_cast("double")))
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(0.0)) + 60 * F.coalesce(F.get(parts, F.lit(1)), F.lit(0.0)) + 3600 * F.coalesce(F.get(parts, F.lit(2)), F.lit(0.0))
