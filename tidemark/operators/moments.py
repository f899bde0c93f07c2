"""Trends from regression moments per series and month, so that a growing series is not read again.

A month's row holds the number of days, their mean day and value, and the centred
sums that a regression needs. Rows of different months add up exactly as their
days would; a batch changes only the months it touches. A fit reads whole
months off the table and days only for the months that its range cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import join_on
from tidemark.operators.trend import days, fit_range

MOMENTS = ("rows", "n", "mean_x", "mean", "sxx", "sxy", "lo", "hi")


def month_of(date: Column) -> Column:
    """The month as text, which also names a table's partition."""
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))


def month_moments(daily: DataFrame, keys: Sequence[str], date: str = "date", val: str = "val") -> DataFrame:
    """Moments of a daily series per key and month; days without a value count as rows only."""
    known = F.col(val).isNotNull() & F.col(date).isNotNull()
    x, y = F.when(known, days(F.col(date))), F.when(known, F.col(val))
    return daily.groupBy(*keys, month_of(F.col(date)).alias("month")).agg(
        F.count("*").alias("rows"),
        F.count(x).alias("n"),
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean"),
        (F.var_pop(x) * F.count(x)).alias("sxx"),
        (F.covar_pop(x, y) * F.count(x)).alias("sxy"),
        F.min(date).alias("lo"),
        F.max(date).alias("hi"),
    )


def fits(
    moments: DataFrame, daily: DataFrame, keys: Sequence[str], method: str = "complete", years_back: int = 9, other_span: DataFrame | None = None
) -> DataFrame:
    """One line per series: rows, n, slope (NULL where all days are equal), mean_x, mean, and the range fitted (``_lo``, ``_hi``).

    The methods are those of ``trend.with_trend``. ``daily`` is read only where a
    range begins or ends inside a month: a table partitioned by ``month`` is
    pruned to those months of those series.
    """
    span = moments.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows"))
    ranged = fit_range(span, keys, method, years_back, other_span)
    held = join_on(moments, ranged.select(*keys, "_lo", "_hi"), keys)
    apart = (F.col("hi") < F.col("_lo")) | (F.col("lo") > F.col("_hi"))
    whole = (F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi"))
    inside = held.filter(whole)
    cut = held.filter(~whole & ~apart).select(*keys, "month", "_lo", "_hi")
    rows = daily if "month" in daily.columns else daily.withColumn("month", month_of(F.col("date")))
    border = join_on(rows, cut, [*keys, "month"]).filter(F.col("date").between(F.col("_lo"), F.col("_hi")))
    parts = inside.select(*keys, *MOMENTS).unionByName(month_moments(border, keys).select(*keys, *MOMENTS)).filter("n > 0")
    # a series has as many parts as it has months: a window over them is short
    w = Window.partitionBy(*keys)
    weighted = lambda c: F.sum(F.col("n") * F.col(c)).over(w) / F.sum("n").over(w)
    centred = parts.withColumns({"_x": weighted("mean_x"), "_y": weighted("mean")})
    off_x, off_y = F.col("mean_x") - F.col("_x"), F.col("mean") - F.col("_y")
    total = centred.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("_x").alias("mean_x"),
        F.first("_y").alias("mean"),
        F.sum(F.col("sxx") + F.col("n") * off_x * off_x).alias("_sxx"),
        F.sum(F.col("sxy") + F.col("n") * off_x * off_y).alias("_sxy"),
    )
    line = total.withColumn("slope", F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx"))).drop("_sxx", "_sxy")
    return join_on(ranged.select(*keys, "rows", "_lo", "_hi"), line, keys, "left")


def with_fits(series: DataFrame, lines: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """The series with ``trend`` read off its line, as ``trend.with_trend`` gives it."""
    tagged = join_on(series, lines.select(*keys, "rows", "slope", "mean_x", "mean", "_lo", "_hi"), keys, "left")
    inside = F.coalesce(F.col(date).between(F.col("_lo"), F.col("_hi")), F.lit(False)) & (F.col("rows") > 1)
    line = F.coalesce(F.col("mean") + F.col("slope") * (days(F.col(date)) - F.col("mean_x")), F.col("mean"))
    return tagged.withColumn("trend", F.when(inside, line)).drop("rows", "slope", "mean_x", "mean", "_lo", "_hi")
