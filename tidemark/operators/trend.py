"""Least-squares trend lines for all series in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import join_on
from tidemark.session import saved


def days(c: Column) -> Column:
    return F.unix_date(c).cast("double")


def _fitted(w, inside: Column, x: Column, y: Column) -> Column:
    """Fitted value at ``x``; a flat line at the mean when all x are equal."""
    yi, xi = F.when(inside, y), F.when(inside, x)
    # through the means: no cancellation between slope * x and an intercept far away
    line = F.avg(yi).over(w) + F.regr_slope(yi, xi).over(w) * (x - F.regr_avgx(yi, xi).over(w))
    return F.when(inside, F.coalesce(line, F.avg(yi).over(w)))


def with_trend(
    series: DataFrame,
    keys: Sequence[str],
    method: str = "complete",
    years_back: int = 9,
    other_span: DataFrame | None = None,
    date: str = "date",
    val: str = "val",
) -> DataFrame:
    """Add ``trend``, the fitted value, to series of at most one row per day and key.

    ``complete`` fits the whole series. ``recent`` fits the last ``years_back``
    years and nothing when the series is shorter than that. ``shortest`` fits
    inside the shorter of this series' range and the one ``other_span`` gives
    per key (``lo``, ``hi``); without one it equals ``complete``. Rows outside
    the fit, and series of a single row, get NULL.

    A window is safe here because the calendar bounds a daily series; use
    ``with_row_trend`` for raw readings.
    """
    w = Window.partitionBy(*keys)
    d = F.col(date)
    df = series
    lo, hi = F.min(date).over(w), F.max(date).over(w)
    if method == "recent":
        since = F.add_months(hi, -12 * years_back)
        df = df.withColumns({"_lo": F.when(since >= lo, since), "_hi": hi})
    elif method == "shortest" and other_span is not None:
        df = join_on(df, other_span.select(*keys, F.col("lo").alias("_olo"), F.col("hi").alias("_ohi")), keys, "left")
        shorter = F.datediff("_ohi", "_olo") < F.datediff(hi, lo)
        df = df.withColumns({"_lo": F.when(shorter, F.col("_olo")).otherwise(lo),
                             "_hi": F.when(shorter, F.col("_ohi")).otherwise(hi)}).drop("_olo", "_ohi")
    elif method in ("complete", "shortest"):
        df = df.withColumns({"_lo": lo, "_hi": hi})
    else:
        raise ValueError("method must be 'complete', 'recent' or 'shortest'")
    inside = F.coalesce(d.between(F.col("_lo"), F.col("_hi")), F.lit(False))
    fitted = _fitted(w, inside, days(d), F.col(val))
    many = F.count("*").over(w) > 1
    return df.withColumn("trend", F.when(many, fitted)).drop("_lo", "_hi")


def span(series: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """First and last date per series."""
    return series.groupBy(*keys).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))


def fit_range(spans: DataFrame, keys: Sequence[str], method: str, years_back: int = 9, other_span: DataFrame | None = None) -> DataFrame:
    """Spans (``lo``, ``hi``) with the range that a method fits (``_lo``, ``_hi``): NULL where there is none."""
    if method == "recent":
        since = F.add_months("hi", -12 * years_back)
        return spans.withColumns({"_lo": F.when(since >= F.col("lo"), since), "_hi": F.col("hi")})
    if method == "shortest" and other_span is not None:
        o = other_span.select(*keys, F.col("lo").alias("_olo"), F.col("hi").alias("_ohi"))
        shorter = F.datediff("_ohi", "_olo") < F.datediff("hi", "lo")
        return join_on(spans, o, keys, "left").withColumns({
            "_lo": F.when(shorter, F.col("_olo")).otherwise(F.col("lo")), "_hi": F.when(shorter, F.col("_ohi")).otherwise(F.col("hi")),
        }).drop("_olo", "_ohi")
    if method in ("complete", "shortest"):
        return spans.withColumns({"_lo": F.col("lo"), "_hi": F.col("hi")})
    raise ValueError("method must be 'complete', 'recent' or 'shortest'")


def trend_coefficients(rows: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Slope, intercept, mean and count per series: partially aggregated, so a series may be any size."""
    return rows.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_avgy(y, x).alias("mean"),
        F.regr_count(y, x).alias("n"),
    )


def with_row_trend(
    rows: DataFrame,
    keys: Sequence[str],
    x: Column,
    method: str = "complete",
    years_back: int = 9,
    other_span: DataFrame | None = None,
    date: str = "date",
    val: str = "val",
) -> DataFrame:
    """``with_trend`` for series of any number of rows.

    The span, then the coefficients are grouped (one row per series each),
    saved and joined back, so no series is gathered in one task and readings
    are shuffled only if there are too many series to broadcast.
    """
    if method in ("complete", "shortest") and (method == "complete" or other_span is None):
        reach = None
    else:
        reach = fit_range(span(rows, keys, date), keys, method, years_back, other_span).drop("lo", "hi")
    if reach is None:
        tagged, inside = rows, F.lit(True)
    else:
        tagged = join_on(rows, saved(reach, "fit-range"), keys, "left")
        inside = F.coalesce(F.col(date).between(F.col("_lo"), F.col("_hi")), F.lit(False))
    tagged = tagged.withColumns({"_x": x, "_in": inside})
    yi, xi = F.when(F.col("_in"), F.col(val)), F.when(F.col("_in"), F.col("_x"))
    fit = tagged.groupBy(*keys).agg(
        F.regr_slope(yi, xi).alias("_slope"),
        F.regr_avgx(yi, xi).alias("_mean_x"),
        F.avg(yi).alias("_mean"),
        F.count("*").alias("_count"),
    )
    line = F.coalesce(F.col("_mean") + F.col("_slope") * (F.col("_x") - F.col("_mean_x")), F.col("_mean"))
    joined = join_on(tagged, saved(fit, "fit"), keys, "inner")
    return joined.withColumn("trend", F.when(F.col("_in") & (F.col("_count") > 1), line)).drop(
        "_x", "_in", "_lo", "_hi", "_slope", "_mean_x", "_mean", "_count"
    )
