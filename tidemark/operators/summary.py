"""Means per region and station, comparison of two parameters, spans, catalogue, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text, values
from tidemark.functions.labels import parameter_label
from tidemark.operators.filters import Day, in_range, pair_filter, select_samples, valid
from tidemark.operators.joins import join_on, with_gauge, with_region, with_station_info
from tidemark.operators.reshape import union_by_name
from tidemark.session import saved

_STATION = ("waterbody", "station")


def _station_partials(rows: DataFrame, *extra: str) -> DataFrame:
    """Sum and count per station.

    Done before any join: readings of a busy station are combined on the map
    side, and from here on there are only as many rows as stations.
    """
    return rows.groupBy(*_STATION, *extra).agg(F.sum("val").alias("_sum"), F.count("val").alias("_n"))


def _mean() -> Column:
    return F.sum("_sum") / F.sum("_n")


def _region_means(rows: DataFrame, stations: DataFrame, regions: DataFrame, *extra: str) -> DataFrame:
    known = with_station_info(
        _station_partials(rows, *extra), stations.select(*_STATION, "WBID", "WATERBODY_NAME")
    )
    key = text.build_key(F.col("waterbody"), F.col("station"))
    means = known.groupBy("WBID", "WATERBODY_NAME", *extra).agg(
        _mean().alias("val"), F.count_distinct(key).alias("n_stations")
    )
    means = means.withColumn("stas", text.station_count_text(F.col("n_stations")))
    return valid(with_region(means, regions))


def _station_means(rows: DataFrame, stations: DataFrame, *extra: str) -> DataFrame:
    means = _station_partials(rows, *extra).select(
        *_STATION, *extra, (F.col("_sum") / F.col("_n")).alias("val")
    )
    # the inner join also drops unknown stations, which have no place on a map
    known = with_station_info(means, stations.select(*_STATION, "WATERBODY_NAME", "lon", "lat"))
    return valid(known).withColumn("stas", text.build_key(F.col("waterbody"), F.col("station")))


def area_summary(
    samples: DataFrame,
    stations: DataFrame,
    regions: DataFrame,
    by: str,
    parameter: str,
    location: str,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """Mean of one parameter per ``region`` (readings pooled over stations) or per ``station``.

    A region row carries its number of stations, and stations without a known
    region are left out; station rows keep them.
    """
    rows = select_samples(samples, parameter, location, start, end)
    if by == "region":
        return _region_means(rows, stations, regions)
    if by == "station":
        return _station_means(rows, stations)
    raise ValueError("by must be 'region' or 'station'")


def _rain_parts(rain: DataFrame, start: Day | None, end: Day | None) -> DataFrame:
    rows = valid(rain.filter(in_range(F.col("date"), start, end)), "precip_inches")
    parts = rows.groupBy("station", "name").agg(
        F.sum("precip_inches").alias("_sum"), F.count("precip_inches").alias("_n")
    )
    return parts.withColumn("parameter", F.lit("rain"))


def rain_region_means(
    rain: DataFrame, gauges: DataFrame, rain_regions: DataFrame, start: Day | None = None, end: Day | None = None
) -> DataFrame:
    """Mean monthly rain per region with its number of gauges."""
    info = gauges.select("station", "name", "WBID", "WATERBODY_NAME")
    known = with_gauge(_rain_parts(rain, start, end), info)
    key = text.build_key(F.col("name"), F.col("station"))
    means = known.groupBy("WBID", "WATERBODY_NAME", "parameter").agg(
        _mean().alias("val"), F.count_distinct(key).alias("n_stations")
    )
    means = means.withColumn("stas", text.station_count_text(F.col("n_stations")))
    return valid(with_region(means, rain_regions))


def rain_gauge_means(
    rain: DataFrame, gauges: DataFrame, start: Day | None = None, end: Day | None = None
) -> DataFrame:
    """Mean monthly rain per gauge; the gauge name takes the waterbody's place."""
    means = _rain_parts(rain, start, end).withColumn("val", F.col("_sum") / F.col("_n")).drop("_sum", "_n")
    known = with_gauge(means, gauges, "left").withColumnRenamed("name", "waterbody")
    return valid(known).withColumn("stas", text.build_key(F.col("waterbody"), F.col("station")))


def compare_summary(
    samples: DataFrame,
    stations: DataFrame,
    regions: DataFrame,
    by: str,
    a: str,
    b: str,
    start: Day | None = None,
    end: Day | None = None,
    rain: DataFrame | None = None,
    gauges: DataFrame | None = None,
    rain_regions: DataFrame | None = None,
    by_location: bool = False,
) -> DataFrame:
    """Means of two choices (``tp_surf``, ``temp_bott``, ``rain``) for the two comparison maps.

    Surface and bottom of one parameter blend into one row unless
    ``by_location`` keeps them apart.
    """
    rows = valid(samples.filter(pair_filter(a, b) & in_range(F.col("date"), start, end)))
    extra = ("parameter", "location") if by_location else ("parameter",)
    wants_rain = "rain" in (text.split_key(a)[0], text.split_key(b)[0])
    if by == "region":
        out = _region_means(rows, stations, regions, *extra)
        if wants_rain:
            out = union_by_name(out, rain_region_means(rain, gauges, rain_regions, start, end))
    elif by == "station":
        out = _station_means(rows, stations, *extra).drop("WATERBODY_NAME")
        if wants_rain:
            out = union_by_name(out, rain_gauge_means(rain, gauges, start, end))
    else:
        raise ValueError("by must be 'region' or 'station'")
    return out


def station_span(samples: DataFrame) -> DataFrame:
    """First and last date per station."""
    return samples.groupBy(*_STATION).agg(F.min("date").alias("datestr"), F.max("date").alias("dateend"))


def with_span(stations: DataFrame, samples: DataFrame) -> DataFrame:
    return join_on(stations.drop("datestr", "dateend"), station_span(samples), _STATION, "left")


def catalogue(samples: DataFrame) -> DataFrame:
    """Distinct (type, units, location, parameter) with its date span and labels: one grouping."""
    keys = ("type", "units", "location", "parameter")
    spans = valid(samples).groupBy(*keys).agg(F.min("date").alias("datestr"), F.max("date").alias("dateend"))
    p, u = F.col("parameter"), F.col("units")
    return spans.withColumns(
        {"label": parameter_label(p, u), "labelnouni": parameter_label(p, u, with_unit=False)}
    )


def overview(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """Numbers of readings, parameters, stations and waterbodies, and the years covered.

    Grouped by (parameter, waterbody) first, so the distinct counts run over a
    handful of rows.
    """
    parts = samples.groupBy("parameter", "waterbody").agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    figures = parts.agg(
        F.sum("n").alias("n_samples"),
        F.count_distinct("parameter").alias("n_parameters"),
        F.count_distinct("waterbody").alias("n_waterbodies"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    return figures.select(
        text.thousands(F.col("n_samples")).alias("samples"),
        "n_parameters",
        stations.select(F.count("*")).scalar().alias("n_stations"),
        "n_waterbodies",
        text.year_range_text(F.col("first"), F.col("last")).alias("years"),
    )


def gauge_scale(
    summary: DataFrame, criterion: DataFrame, keys: tuple[str, ...], parameter: str, label: str
) -> DataFrame:
    """Gauge figures per area: value, scale from zero to the largest area mean (or the criterion
    if higher), unit and, for temperature, the Celsius twin.

    The area means are saved once: both the figures and the largest mean come
    from them, without a second pass over the readings.
    """
    summary = saved(summary, "area-means")
    top = summary.select(F.max("val")).scalar()
    tagged = summary.withColumn("_p", F.lit(parameter[:3]))
    crit = criterion.select(*keys, F.col("parameter").alias("_p"), F.col("value").alias("criterion"))
    joined = join_on(tagged, crit, [*keys, "_p"], "left").drop("_p")
    out = joined.withColumns(
        {
            "shown": F.round("val", 2),
            "scale_min": F.lit(0.0),
            "scale_max": F.greatest(top, F.col("criterion")),
            "unit": text.unit_of_label(F.lit(label)),
        }
    )
    if parameter != "temp":
        return out
    return out.withColumns(
        {"shown_celsius": F.round(values.celsius(F.col("val")), 2), "unit": F.concat("unit", F.lit(" / C"))}
    )
