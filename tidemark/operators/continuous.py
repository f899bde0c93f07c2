"""Batch queries over continuous sensor readings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, text, values
from tidemark.functions.student import t_bounds
from tidemark.operators.filters import valid
from tidemark.operators.joins import with_station_info
from tidemark.operators.trend import with_row_trend
from tidemark.session import saved

SERIES = ("waterbody", "station", "variable")


def continuous_long(wide: DataFrame, parameter: str | None = None) -> DataFrame:
    """Wide readings to (waterbody, station, timestamp, variable, val), for the columns whose name
    contains ``parameter`` (default: all). Other columns are never read."""
    ids = ["waterbody", "station", "timestamp"]
    cols = [c for c in wide.columns if c not in ids and (parameter is None or parameter in c)]
    return wide.select(*ids, *cols).unpivot(ids, cols, "variable", "val")


def between_times(readings: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Both ends included; a bare date means its midnight."""
    t = F.col("timestamp")
    kind = readings.schema["timestamp"].dataType
    if start is not None:
        readings = readings.filter(t >= F.lit(start).cast(kind))
    if end is not None:
        readings = readings.filter(t <= F.lit(end).cast(kind))
    return readings


def continuous_station_mean(
    wide: DataFrame, stations: DataFrame, parameter: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Mean of one variable per station in a time range, with the station's position."""
    rows = between_times(continuous_long(wide, parameter), start, end)
    means = valid(rows).groupBy(*SERIES).agg(F.avg("val").alias("val"))
    return with_station_info(means, stations.select("waterbody", "station", "WATERBODY_NAME", "lon", "lat"), "left")


def continuous_gauge(means: DataFrame, label: str) -> DataFrame:
    """Gauge figures per station: value, scale from zero to the largest mean, unit."""
    means = saved(means, "station-means")
    top = means.select(F.max("val")).scalar()
    return means.select(
        text.build_key(F.col("waterbody"), F.col("station")).alias("stas"),
        F.round("val", 2).alias("shown"),
        F.lit(0.0).alias("scale_min"),
        F.round(top, 2).alias("scale_max"),
        text.unit_of_label(F.lit(label)).alias("unit"),
    )


def continuous_period(
    wide: DataFrame, parameter: str, period: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Mean with interval per station and day, Sunday week, month, quarter or year."""
    rows = valid(between_times(continuous_long(wide, parameter), start, end))
    grouped = rows.groupBy(*SERIES, dates.period_floor(F.col("timestamp"), period).alias("date")).agg(
        F.count("val").alias("n"), F.avg("val").alias("val"), F.var_samp("val").alias("_var")
    )
    lo, hi = t_bounds("n", "val", "_var")
    return grouped.select(*SERIES, "date", "n", "val", lo.alias("lovl"), hi.alias("hivl"))


def continuous_trend(
    wide: DataFrame, parameter: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Readings with the least-squares line over epoch milliseconds (fractions kept)."""
    rows = valid(between_times(continuous_long(wide, parameter), start, end))
    x = F.unix_micros(F.col("timestamp").cast("timestamp")) / F.lit(1000.0)
    return with_row_trend(rows, SERIES, x, date="timestamp")


def daily_wave(ts: Column, peak_hour: float) -> Column:
    """A sine of one day that is 1 at ``peak_hour``."""
    return F.cos((F.hour(ts) - F.lit(float(peak_hour))) * F.lit(math.pi / 12))


def daily_cycle(wide: DataFrame, parameter: str, peak_hour: float = 16) -> DataFrame:
    """The daily cycle of each station: level and amplitude of the wave that fits its readings best, and the spread around it.

    One grouped aggregate of regression sums, combined before the shuffle.
    """
    rows = valid(continuous_long(wide, parameter)).withColumn("_wave", daily_wave(F.col("timestamp"), peak_hour))
    fit = rows.groupBy(*SERIES).agg(
        F.count("val").alias("n"),
        F.regr_intercept("val", "_wave").alias("level"),
        F.regr_slope("val", "_wave").alias("amplitude"),
        (F.regr_syy("val", "_wave") - F.regr_sxy("val", "_wave") * F.regr_slope("val", "_wave")).alias("_left"),
    )
    left = values.clamp_zero(F.col("_left"))
    return fit.withColumn("spread", F.when(F.col("n") > 2, F.sqrt(left / (F.col("n") - 2)))).drop("_left")
