"""Daily and monthly series for every area at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import Day, in_range, pair_filter, select_samples, valid
from tidemark.operators.joins import with_gauge, with_station_info


def station_daily(
    samples: DataFrame, parameter: str, location: str, start: Day | None = None, end: Day | None = None
) -> DataFrame:
    """Mean per station and day."""
    rows = select_samples(samples, parameter, location, start, end)
    return rows.groupBy("waterbody", "station", "date").agg(F.avg("val").alias("val"))


def region_daily(
    samples: DataFrame,
    stations: DataFrame,
    parameter: str,
    location: str,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """Mean over a region's readings per day."""
    rows = select_samples(samples, parameter, location, start, end)
    known = with_station_info(
        rows.select("waterbody", "station", "date", "val"), _regions_of(stations)
    )
    return known.groupBy("WBID", "date").agg(F.avg("val").alias("val"))


def region_daily_by_parameter(
    samples: DataFrame, stations: DataFrame, choices: tuple[str, ...] = (), start: Day | None = None, end: Day | None = None
) -> DataFrame:
    """Mean per region, day, parameter and location, for all or some ``parameter_location`` choices."""
    ok = in_range(F.col("date"), start, end)
    if choices:
        ok = ok & pair_filter(choices[0], choices[-1])
    rows = valid(samples.filter(ok)).select("waterbody", "station", "date", "parameter", "location", "val")
    known = with_station_info(rows, _regions_of(stations))
    return known.groupBy("WBID", "date", "parameter", "location").agg(F.avg("val").alias("val"))


def _regions_of(stations: DataFrame) -> DataFrame:
    return stations.filter("WBID IS NOT NULL").select("waterbody", "station", "WBID")


def rain_series(
    rain: DataFrame,
    gauges: DataFrame,
    by: str,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """Monthly rain per gauge, or averaged over the gauges of each region.

    Columns follow the comparison series: ``waterbody`` is the gauge name or
    the region id; ``parameter`` is ``rain`` and ``location`` is ``surf``.
    """
    rows = valid(rain.filter(in_range(F.col("date"), start, end)), "precip_inches")
    tags = {"parameter": F.lit("rain"), "location": F.lit("surf")}
    if by == "station":
        gauge = rows.select(F.col("name").alias("waterbody"), "station", "date", F.col("precip_inches").alias("val"))
        return gauge.withColumns(tags)
    known = with_gauge(rows, gauges.filter("WBID IS NOT NULL").select("station", "name", "WBID"))
    mean = known.groupBy(F.col("WBID").alias("waterbody"), "date").agg(F.avg("precip_inches").alias("val"))
    return mean.withColumn("station", F.col("waterbody")).withColumns(tags)
