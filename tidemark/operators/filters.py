"""Row selection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import split_key
from tidemark.functions.values import present

Day = str | Date


def in_range(c: Column, start: Day | None, end: Day | None) -> Column:
    """Date range with both ends included; an open end is not tested."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (c >= F.lit(str(start)).cast("date"))
    if end is not None:
        ok = ok & (c <= F.lit(str(end)).cast("date"))
    return ok


def valid(df: DataFrame, column: str = "val") -> DataFrame:
    """Drop rows without a measured value."""
    return df.filter(present(F.col(column)))


def select_samples(
    samples: DataFrame,
    parameter: str | None = None,
    location: str | None = None,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """Valid readings of one parameter at one location in a date range; ``None`` means any."""
    ok = in_range(F.col("date"), start, end)
    if parameter is not None:
        ok = ok & (F.col("parameter") == parameter)
    if location is not None:
        ok = ok & (F.col("location") == location)
    return valid(samples.filter(ok))


def pair_filter(a: str, b: str) -> Column:
    """Either of two ``parameter_location`` choices, matched exactly."""

    def one(choice: str) -> Column:
        p, loc = split_key(choice)
        return (F.col("parameter") == p) & (F.col("location") == loc)

    return one(a) | one(b)


def export_filter(
    samples: DataFrame, waterbodies: Sequence[str] | DataFrame, parameters: Sequence[str], start: Day, end: Day
) -> DataFrame:
    """The rows of a download: chosen waterbodies and parameters in a date range, without ``type``.

    A long waterbody choice may be given as a frame and becomes a semi join.
    """
    kept = samples.filter(F.col("parameter").isin(*parameters) & in_range(F.col("date"), start, end))
    if isinstance(waterbodies, DataFrame):
        kept = kept.join(waterbodies.select("waterbody").distinct(), "waterbody", "left_semi")
    else:
        kept = kept.filter(F.col("waterbody").isin(*waterbodies))
    return kept.drop("type")


def table_view(export: DataFrame, digits: int = 3) -> DataFrame:
    """Export rows as the preview table shows them: values rounded, notes hidden."""
    return export.withColumn("val", F.round("val", digits)).drop("notes")


def wet_days(rain: DataFrame, column: str = "precip_inches") -> DataFrame:
    """Days with rain; missing values, NaN among them, are no rain."""
    return rain.filter(present(F.col(column)) & (F.col(column) > 0))


def gauge_or_region(rain: DataFrame, choice: str) -> DataFrame:
    """Rows of the gauge of that name or of all gauges in that region."""
    return rain.filter((F.col("name") == choice) | (F.col("WBID") == choice))


def nothing(df: DataFrame) -> DataFrame:
    """The empty series of a side on which nothing is selected."""
    return df.filter(F.lit(False))
