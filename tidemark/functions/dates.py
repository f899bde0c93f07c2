"""Calendar floors, seasons and selectable date steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASONS = ("winter", "spring", "summer", "fall")


def parse_mdy(c: Column) -> Column:
    """Month/day/year text to a date; bad text becomes NULL.

    Slashes, dashes, dots and English month names are read; two-digit years up to
    68 are of this century, later ones of the last. Later spellings are tried only
    where the earlier ones fail, and only on text that holds their separator: a
    failed try costs far more than the look.
    """

    def tried(text: Column, pattern: str) -> Column:
        held = F.contains(text, F.lit(next(x for x in "/-., " if x in pattern)))
        if pattern[0] == "M" and pattern[1] in "/-.":
            held = held & ~text.rlike("^[1-9][0-9]{3}[-/.]")  # no month
        return F.when(held, F.try_to_date(text, pattern))

    long_years = [tried(c, p) for p in ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "M.d.yyyy", "yyyy/M/d")]
    names = [tried(F.initcap(c), p) for p in ("MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy")]
    short = F.coalesce(*[tried(c, p) for p in ("M/d/yy", "M-d-yy", "M.d.yy")])
    return F.coalesce(*long_years, *names, F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short))


def month_floor(d: Column) -> Column:
    return F.trunc(d, "MM")


def year_floor(d: Column) -> Column:
    return F.trunc(d, "YEAR")


def period_floor(c: Column, period: str) -> Column:
    """Floor a date or timestamp to a day, Sunday-based week, month, quarter or year, as a date."""
    day = F.to_date(c)
    if period == "day":
        return day
    if period == "week":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if period in ("month", "quarter", "year"):
        return F.trunc(day, period)
    raise ValueError(f"unknown period: {period}")


def wet_dry(d: Column) -> Column:
    return F.when(F.month(d).between(6, 9), "wet").when(d.isNotNull(), "dry")


def season(d: Column) -> Column:
    m = F.month(d)
    return (
        F.when(m.isin(12, 1, 2), "winter")
        .when(m.between(3, 5), "spring")
        .when(m.between(6, 8), "summer")
        .when(d.isNotNull(), "fall")
    )


def epoch_ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def date_steps(first: Column, last: Column) -> Column:
    """First date, each month start strictly between, last date, without repeats."""
    start = F.add_months(month_floor(first), 1)
    stop = month_floor(last)
    months = F.when(
        start <= stop, F.sequence(start, stop, F.expr("interval 1 month"))
    ).otherwise(F.array().cast("array<date>"))
    return F.array_distinct(F.concat(F.array(first), months, F.array(last)))
