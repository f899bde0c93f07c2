"""Pick-lists and display labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import dates, text
from tidemark.functions.labels import location_name
from tidemark.operators.filters import Day, in_range
from tidemark.operators.joins import join_on, with_labels
from tidemark.operators.reshape import union_by_name


def waterbody_list(samples: DataFrame) -> DataFrame:
    return samples.select("waterbody").distinct().orderBy("waterbody")


def parameter_list(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("parameter", "labelnouni").distinct().orderBy("parameter")


def parameter_choices(
    samples: DataFrame, rain: DataFrame, catalogue: DataFrame, start: Day, end: Day
) -> DataFrame:
    """Selectable ``parameter_location`` keys with labels; rainfall comes first if any fell in range.

    The location is named only where a parameter has both. Labels sort the
    English way, capitals beside small letters.
    """
    pairs = samples.filter(in_range(F.col("date"), start, end)).select("parameter", "location").distinct()
    labelled = with_labels(pairs, catalogue)
    counts = labelled.groupBy("parameter").agg(F.count("*").alias("cnt"))
    joined = join_on(labelled, counts, ["parameter"], "inner")
    loc = F.col("location")
    suffix = (
        F.when((loc == "surf") & (F.col("cnt") == 2), "Surface")
        .when(loc == "bott", "Bottom")
        .when((loc == "surf") & (F.col("cnt") == 1), "")
        .otherwise(loc)
    )
    label = F.concat_ws(": ", F.coalesce("labelnouni", F.lit("NA")), F.coalesce(suffix, F.lit("NA")))
    chosen = joined.select(
        text.build_key(F.col("parameter"), loc).alias("choice"),
        F.regexp_replace(label, r": $", "").alias("label"),
        F.lit(1).alias("_group"),
    )
    rained = rain.filter(in_range(F.col("date"), start, end)).limit(1)
    first = rained.select(F.lit("rain").alias("choice"), F.lit("Rainfall").alias("label"), F.lit(0).alias("_group"))
    return union_by_name(first, chosen).orderBy("_group", F.expr("label COLLATE en"), "choice").drop("_group")


def location_choices(catalogue: DataFrame) -> DataFrame:
    """Sample locations per parameter, surface before bottom."""
    codes = [c for c, _ in S.LOCATIONS]
    place = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("location"))
    return (
        catalogue.filter(F.col("location").isin(*codes))
        .select("parameter", "location")
        .distinct()
        .select("parameter", location_name(F.col("location")).alias("label"), "location", place.alias("place"))
        .orderBy("parameter", "place")
    )


def date_choices(
    samples: DataFrame,
    location: Sequence[str] | None = None,
    parameter: Sequence[str] | None = None,
    waterbody: Sequence[str] | None = None,
) -> DataFrame:
    """First date, the month starts between, last date of the chosen rows (default: all rows)."""
    rows = samples
    for name, wanted in (("location", location), ("parameter", parameter), ("waterbody", waterbody)):
        if wanted is not None:
            rows = rows.filter(F.col(name).isin(*wanted))
    ends = rows.agg(F.min("date").alias("first"), F.max("date").alias("last")).filter("first IS NOT NULL")
    return ends.select(F.explode(dates.date_steps(F.col("first"), F.col("last"))).alias("date"))


def axis_labels(catalogue: DataFrame, mean: bool = True) -> DataFrame:
    """Axis label per parameter and location: the location shows only where there are several."""
    rows = catalogue.select("parameter", "location", "label").distinct()
    places = rows.groupBy("parameter").agg(F.count_distinct("location").alias("_n"))
    joined = join_on(rows, places, ["parameter"], "inner")
    suffix = F.when(F.col("_n") == 1, "").when(F.col("location") == "surf", ": Surface").otherwise(": Bottom")
    head = F.lit("Mean " if mean else "")
    return joined.select(
        "parameter",
        "location",
        F.concat(head, F.coalesce("label", F.lit("NA")), suffix).alias("axis_label"),
    )


def axis_labels_with_rain(catalogue: DataFrame, mean: bool = True) -> DataFrame:
    """``axis_labels`` and the row for rainfall totals, which needs no catalogue entry."""
    labels = axis_labels(catalogue, mean)
    rain = catalogue.sparkSession.createDataFrame(
        [("rain", "rain", S.RAIN_SERIES_LABEL)], "parameter string, location string, axis_label string"
    )
    return union_by_name(labels, rain)


def area_titles(stations: DataFrame) -> DataFrame:
    """Title of every region and station: ``NAME (ID)``."""
    regions = (
        stations.filter("WBID IS NOT NULL")
        .select(F.col("WBID").alias("id"), text.title(F.col("WATERBODY_NAME"), F.col("WBID")).alias("title"))
        .distinct()
    )
    single = stations.select(
        text.build_key(F.col("waterbody"), F.col("station")).alias("id"),
        text.title(F.col("waterbody"), F.col("station")).alias("title"),
    ).distinct()
    return union_by_name(regions, single)
