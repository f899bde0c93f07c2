"""Means with 95 % intervals (or totals, for rain) per year, season, wet or dry season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions.student import t_bounds
from tidemark.operators.filters import valid

SERIES = ("waterbody", "station", "parameter", "location")
PERIODS = ("year", "season", *dates.SEASONS, "wet season", "dry season")


def _label(period: str, month: Column) -> Column:
    return dates.wet_dry(month) if period.endswith(" season") else dates.season(month)


def with_runs(months: DataFrame, keys: Sequence[str], label: str = "label", order: str = "month") -> DataFrame:
    """Number the runs of equal labels in each series and give each its first month.

    ``months`` holds one row per series and month, so a window over a series
    sorts at most its calendar months, however many readings it has. A season
    without data does not split its neighbours.
    """
    along = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.col(label).eqNullSafe(F.lag(label).over(along)), 0).otherwise(1)
    marked = months.withColumn("_changed", changed)
    numbered = marked.withColumn("run", F.sum("_changed").over(along)).drop("_changed")
    return numbered.withColumn("start", F.min(order).over(Window.partitionBy(*keys, "run")))


def period_stats(rows: DataFrame, period: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Per series and period: mean with Student-t bounds, or the total for ``rain``.

    ``rows`` has the key columns, ``date`` and ``val``. Columns added: ``date``
    (start of the period), ``n``, ``val``, ``lovl``, ``hivl``.
    """
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    rows = valid(rows)
    if period == "year":
        grouped = rows.groupBy(*keys, dates.year_floor(F.col("date")).alias("date")).agg(
            F.count("val").alias("n"),
            F.avg("val").alias("mean"),
            F.var_samp("val").alias("variance"),
            F.sum("val").alias("total"),
        )
    else:
        grouped = _by_run(rows, period, keys)
    lo, hi = t_bounds("n", "mean", "variance")
    rain = F.col("parameter") == "rain" if "parameter" in keys else F.lit(False)
    return grouped.select(
        *keys,
        "date",
        "n",
        F.when(rain, F.col("total")).otherwise(F.col("mean")).alias("val"),
        F.when(~rain, lo).alias("lovl"),
        F.when(~rain, hi).alias("hivl"),
    )


def _by_run(rows: DataFrame, period: str, keys: Sequence[str]) -> DataFrame:
    # readings -> one row per series and month (combined before the shuffle)
    months = rows.groupBy(*keys, dates.month_floor(F.col("date")).alias("month")).agg(
        F.count("val").alias("_n"),
        F.avg("val").alias("_mean"),
        (F.var_pop("val") * F.count("val")).alias("_m2"),
        F.sum("val").alias("_total"),
    )
    runs = with_runs(months.withColumn("label", _label(period, F.col("month"))), keys)
    wanted = period.removesuffix(" season")
    if wanted != "season":
        runs = runs.filter(F.col("label") == wanted)
    # months -> runs: squared deviations add up once shifted to the run's own mean
    run = Window.partitionBy(*keys, "start")
    centred = runs.withColumn(
        "_all", F.sum(F.col("_n") * F.col("_mean")).over(run) / F.sum("_n").over(run)
    )
    shift = F.col("_n") * F.pow(F.col("_mean") - F.col("_all"), 2)
    return centred.groupBy(*keys, F.col("start").alias("date")).agg(
        F.sum("_n").alias("n"),
        F.first("_all").alias("mean"),
        F.when(F.sum("_n") > 1, F.sum(F.col("_m2") + shift) / (F.sum("_n") - 1)).alias("variance"),
        F.sum("_total").alias("total"),
    )
