"""Text to DATE and calendar pieces. Everything stays DATE, so no session time zone matters."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` text to DATE, NULL where it is none.

    The cast stays in generated code, unlike a pattern parser, and like the SQL function it
    stands for it ignores a time of day after the date.
    """
    return F.trim(text).try_cast("date")


# How a date that is not ISO may be spelled, shape -> pattern.
FORMATS = {"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$": "d-MMM-yyyy"}


def parse_mixed_date(text: Column, formats: Mapping[str, str] = FORMATS) -> Column:
    """DATE from ``YYYY-MM-DD`` text or the first of ``formats`` whose shape fits; else NULL.

    ``formats`` maps a regular expression to a date pattern. Letter case of month names and
    the choice of ``-`` or space do not matter.
    """
    trimmed = F.trim(text)
    spelled_out = F.initcap(F.replace(trimmed, F.lit("-"), F.lit(" ")))
    day = F.when(trimmed.rlike("^[0-9]{4}-"), parse_iso_date(text))
    for shape, pattern in formats.items():
        day = day.when(trimmed.rlike(shape), F.try_to_date(spelled_out, pattern.replace("-", " ")))
    return day


#: How far apart the first days of neighbouring periods are.
GRAINS = {
    "day": "interval 1 day",
    "week": "interval 7 days",
    "month": "interval 1 month",
    "quarter": "interval 3 months",
    "year": "interval 1 year",
}


def period_of(day: Column, grain: str) -> Column:
    """First day of the day's period: ``day``, ``week`` (from Monday), ``month``, ``quarter``, ``year``."""
    if grain not in GRAINS:
        raise ValueError(f"{grain} is none of {', '.join(GRAINS)}")
    return day if grain == "day" else F.trunc(day, grain)


def month_of(day: Column) -> Column:
    """First day of the month."""
    return F.trunc(day, "MM")


def is_weekend(day: Column) -> Column:
    """Saturday or Sunday; FALSE for an unknown day."""
    return F.coalesce(F.weekday(day) >= 5, F.lit(False))
