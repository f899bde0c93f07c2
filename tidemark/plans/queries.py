"""The analysts' queries. Each serves all areas at once; one selection is a filter on the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.labels import label_of
from tidemark.operators import choices, criteria as crit
from tidemark.operators import continuous as cont
from tidemark.operators import filters, periods, series, summary, trend
from tidemark.operators.filters import Day
from tidemark.operators.joins import join_on
from tidemark.operators.trend import days


def area_map(
    samples: DataFrame, stations: DataFrame, regions: DataFrame, by: str, parameter: str, location: str,
    start: Day | None = None, end: Day | None = None,
) -> DataFrame:
    """Area summary with hover text."""
    out = summary.area_summary(samples, stations, regions, by, parameter, location, start, end)
    val = F.col("val")
    if by == "region":
        hover = text.hover_region(F.col("WATERBODY_NAME"), F.col("WBID"), val, F.col("stas"))
    else:
        hover = text.hover_station(F.col("waterbody"), F.col("station"), val)
    return out.withColumn("hover", hover)


def area_series(
    samples: DataFrame, stations: DataFrame, criteria: DataFrame, by: str, parameter: str, location: str,
    start: Day | None = None, end: Day | None = None, show_trend: str = "none", years_back: int = 9,
) -> DataFrame:
    """Daily series per area, in date order, with the fitted trend and the criterion, where there is just one."""
    if by == "region":
        keys = ("WBID",)
        daily = series.region_daily(samples, stations, parameter, location, start, end)
    else:
        keys = ("waterbody", "station")
        daily = series.station_daily(samples, parameter, location, start, end)
    if show_trend != "none":
        daily = trend.with_trend(daily, keys, show_trend, years_back)
    tagged = daily.withColumn("parameter", F.lit(parameter))
    return crit.with_criterion(tagged, criteria, by).orderBy(*keys, "date")


def area_gauge(
    samples: DataFrame, stations: DataFrame, regions: DataFrame, criteria: DataFrame, by: str, parameter: str,
    location: str, start: Day | None = None, end: Day | None = None, label: str | None = None,
) -> DataFrame:
    """Gauge figures of every area."""
    means = summary.area_summary(samples, stations, regions, by, parameter, location, start, end)
    shown = label or label_of(parameter) or parameter
    return summary.gauge_scale(means, crit.unique_criteria(criteria, by), crit.KEYS[by], parameter, shown)


def comparison_side(
    samples: DataFrame, stations: DataFrame, by: str, choice: str, start: Day | None = None, end: Day | None = None,
    period: str = "none", rain: DataFrame | None = None, gauges: DataFrame | None = None, clip_rain: bool = True,
) -> DataFrame:
    """One side of the comparison: (waterbody, station, parameter, location, date, val[, n, lovl, hivl]).

    Regions average per day before any period mean; stations keep their raw
    readings. A region's id stands in for both waterbody and station.
    ``clip_rain=False`` keeps rain outside the date range.
    """
    parameter, location = text.split_key(choice)
    if parameter == "rain":
        rows = series.rain_series(rain, gauges, by, start if clip_rain else None, end if clip_rain else None)
    elif by == "region":
        daily = series.region_daily(samples, stations, parameter, location, start, end)
        rows = daily.select(
            F.col("WBID").alias("waterbody"), F.col("WBID").alias("station"),
            F.lit(parameter).alias("parameter"), F.lit(location).alias("location"), "date", "val",
        )
    else:
        rows = filters.select_samples(samples, parameter, location, start, end).select(
            "waterbody", "station", "parameter", "location", "date", "val"
        )
    return rows if period == "none" else periods.period_stats(rows, period)


def selected(side: DataFrame, choice: str | None) -> DataFrame:
    """The rows of one chosen area: a ``waterbody_station`` key, a region id, or nothing at all.

    A key is cut at its last underscore; a region id has none and stands for both halves. A gauge
    is chosen by ``name_station`` likewise.
    """
    if not choice:
        return filters.nothing(side)
    waterbody, station = text.split_key(choice)
    return side.filter((F.col("waterbody") == waterbody) & (F.col("station") == station))


#: Keys of an area and of the one it is compared with.
PAIR = ("waterbody", "station", "other_waterbody", "other_station")


def area_pairs(spark: SparkSession, chosen: Sequence[tuple[str, str]]) -> DataFrame:
    """Pairs of chosen areas, each written as ``selected`` takes it, for ``comparison_series``."""
    rows = [(*text.split_key(a), *text.split_key(b)) for a, b in chosen]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in PAIR))


def comparison_series(
    side: DataFrame, other: DataFrame, criteria: DataFrame, by: str, show_trend: str = "none", years_back: int = 9,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """A comparison side with its trend and criterion, each area's rows in date order.

    ``other`` is the opposite side; the ``shortest`` trend is fitted inside the
    shorter of both ranges, area by area. Without ``pairs`` an area meets the
    same area of the other side. ``pairs`` (see ``area_pairs``) says which areas
    meet: the result then has each area once per pair, with the other area's
    keys, and only areas that are in a pair. Where the other area has no rows,
    the trend is the complete one.
    """
    area, out = ("waterbody", "station"), side
    keys = area
    if pairs is not None:
        keys = PAIR
        out = join_on(side, pairs.select(*PAIR).distinct(), area)
    if show_trend != "none":
        spans = None
        if show_trend == "shortest":
            spans = trend.span(other, area)
            if pairs is not None:
                met = dict(zip(PAIR[2:], area))
                spans = join_on(pairs.select(*PAIR).distinct(), spans, met)
        # regions and period statistics have a row per day at most; raw station readings any number
        if by == "region" or "lovl" in side.columns:
            out = trend.with_trend(out, keys, show_trend, years_back, spans)
        else:
            out = trend.with_row_trend(out, keys, days(F.col("date")), show_trend, years_back, spans)
    # an empty side shows no criterion by itself: there are no rows to attach it to
    return crit.with_criterion(out, criteria, by, ("waterbody",) if by == "region" else area).orderBy(*keys, "date")


def export_rows(samples: DataFrame, waterbodies, parameters, start: Day, end: Day) -> DataFrame:
    return filters.export_filter(samples, waterbodies, parameters, start, end)


def pick_lists(samples: DataFrame, rain: DataFrame, catalogue: DataFrame, start: Day, end: Day) -> dict[str, DataFrame]:
    return {
        "waterbodies": choices.waterbody_list(samples),
        "parameters": choices.parameter_list(catalogue),
        "locations": choices.location_choices(catalogue),
        "dates": choices.date_choices(samples),
        "comparison": choices.parameter_choices(samples, rain, catalogue, start, end),
    }


def sensor_series(
    wide: DataFrame, parameter: str, period: str = "none", start: str | None = None, end: str | None = None,
    show_trend: bool = False,
) -> DataFrame:
    """Continuous readings of every station, raw or per period, in order of time, with an optional trend."""
    if period == "none":
        if show_trend:
            out = cont.continuous_trend(wide, parameter, start, end)
        else:
            out = filters.valid(cont.between_times(cont.continuous_long(wide, parameter), start, end))
        return out.orderBy(*cont.SERIES, "timestamp")
    out = cont.continuous_period(wide, parameter, period, start, end)
    return (trend.with_trend(out, cont.SERIES) if show_trend else out).orderBy(*cont.SERIES, "date")
