"""Data-quality checks: each returns a frame of violations, empty when all is well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions.labels import parameter_label
from tidemark.functions.text import build_key
from tidemark.functions.values import present
from tidemark.operators.filters import Day
from tidemark.operators.joins import join_on
from tidemark.operators.ordered import previous_value
from tidemark.operators.spatial import outside_box

_STATION = ("waterbody", "station")


def missing_keys(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``known`` lacks."""
    return join_on(df.select(*keys).distinct(), known.select(*keys).distinct(), keys, "left_anti")


def unknown_physical_stations(samples: DataFrame, stations: DataFrame) -> DataFrame:
    return missing_keys(samples.filter("type = 'physical'"), stations, _STATION)


def unknown_discrete_stations(samples: DataFrame, stations: DataFrame) -> DataFrame:
    return missing_keys(samples.filter("type = 'discrete'"), stations, _STATION)


def unknown_continuous_stations(continuous: DataFrame, stations: DataFrame) -> DataFrame:
    return missing_keys(continuous, stations, _STATION)


def backward_steps(continuous: DataFrame, order: str, chunk: Column, keys: Sequence[str] = _STATION) -> DataFrame:
    """Readings whose time is not later than the one before, in order of arrival, for all stations.

    ``order`` numbers the arrivals of a station and ``chunk`` cuts them into
    stretches of bounded length (for example ``order div 100000``).
    """
    stepped = previous_value(continuous, keys, chunk, order, "timestamp", "previous")
    return stepped.filter(F.col("timestamp") <= F.col("previous")).select(*keys, order, "previous", "timestamp")


def _expected(df: DataFrame, values: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], "value string")


def set_mismatch(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Values beyond the expected ones and expected values that never occur."""
    found = df.select(F.col(column).alias("value")).distinct()
    want = _expected(df, expected)
    surplus = join_on(found, want, ["value"], "left_anti").withColumn("problem", F.lit("unexpected"))
    absent = join_on(want, found, ["value"], "left_anti").withColumn("problem", F.lit("missing"))
    return surplus.unionByName(absent)


def values_outside(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values that are not allowed; NULL is no value."""
    found = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    return join_on(found, _expected(df, allowed), ["value"], "left_anti")


def county_mismatch(samples: DataFrame, expected: Sequence[str] = S.COUNTIES) -> DataFrame:
    return set_mismatch(samples.filter("county IS NOT NULL"), "county", expected)


def waterbody_mismatch(samples: DataFrame, expected: Sequence[str] = S.WATERBODIES) -> DataFrame:
    return set_mismatch(samples.filter("waterbody IS NOT NULL"), "waterbody", expected)


def _outside(first: Day, last: Day | None = None) -> Column:
    d = F.col("date")
    end = F.current_date() if last is None else F.lit(str(last)).cast("date")
    return d.isNull() | (d < F.lit(str(first)).cast("date")) | (d > end)


def _bad_rain() -> Column:
    v = F.col("precip_inches")
    return v.isNull() | F.isnan(v) | (v < 0)


def _bad_location() -> Column:
    loc = F.col("location")
    return loc.isNull() | ~loc.isin(*[c for c, _ in S.LOCATIONS])


def row_metrics(first_sample: Day = S.FIRST_SAMPLE_DATE, first_rain: Day = S.FIRST_RAIN_DATE, last: Day | None = None) -> dict[str, dict[str, Column]]:
    """Per table the checks that look at one row at a time, as counts of bad rows: metrics for ``observe`` while the table is written."""
    def count(bad: Column) -> Column:
        return F.count(F.when(bad, 1))

    return {
        "samples": {"sample dates": count(_outside(first_sample, last)), "sample locations": count(_bad_location())},
        "rain": {"rain values": count(_bad_rain()), "rain dates": count(_outside(first_rain, last))},
    }


def dates_outside(df: DataFrame, first: Day, last: Day | None = None) -> DataFrame:
    """Dates (with their number of rows) before ``first`` or after ``last`` (default today); a missing date is one too."""
    return df.filter(_outside(first, last)).groupBy("date").agg(F.count("*").alias("n"))


def sample_dates_outside(samples: DataFrame, first: Day = S.FIRST_SAMPLE_DATE, last: Day | None = None) -> DataFrame:
    return dates_outside(samples, first, last)


def rain_dates_outside(rain: DataFrame, first: Day = S.FIRST_RAIN_DATE, last: Day | None = None) -> DataFrame:
    return dates_outside(rain, first, last)


def stations_outside_box(stations: DataFrame, box: Mapping[str, float] = S.STATION_BOX, buffer: float = 0.0) -> DataFrame:
    return outside_box(stations, box, buffer)


def stations_without_criteria(samples: DataFrame, criteria: DataFrame) -> DataFrame:
    return missing_keys(samples, criteria, _STATION)


def criteria_unknown_regions(criteria: DataFrame, regions: DataFrame) -> DataFrame:
    return missing_keys(criteria, regions, ["WBID"])


def parameters_without_entry(samples: DataFrame, catalogue: DataFrame) -> DataFrame:
    return missing_keys(samples, catalogue, ["parameter"])


def negative_rain(rain: DataFrame) -> DataFrame:
    """Rain below zero or missing; zero is fine."""
    return rain.filter(_bad_rain())


def unknown_gauges(rain: DataFrame, gauges: DataFrame) -> DataFrame:
    return missing_keys(rain, gauges, ["station"])


def region_problems(
    places: DataFrame, regions: DataFrame, expected: Sequence[str], without_region: int
) -> DataFrame:
    """Region ids of stations or gauges that are not expected or not known, and a row when the
    number of places without a region is wrong."""
    ids = places.select(F.col("WBID").alias("value")).filter("value IS NOT NULL").distinct()
    unexpected = join_on(ids, _expected(places, expected), ["value"], "left_anti").withColumn(
        "problem", F.lit("unexpected")
    )
    unknown = join_on(
        ids, regions.select(F.col("WBID").alias("value")).distinct(), ["value"], "left_anti"
    ).withColumn("problem", F.lit("unknown"))
    bare = places.agg(F.count(F.when(F.col("WBID").isNull(), 1)).alias("n")).filter(F.col("n") != without_region)
    count = bare.select(F.col("n").cast("string").alias("value"), F.lit("without region").alias("problem"))
    return unexpected.unionByName(unknown).unionByName(count)


def gauge_region_problems(
    gauges: DataFrame, rain_regions: DataFrame, expected: Sequence[str] = S.GAUGE_REGION_IDS,
    without_region: int = S.GAUGES_WITHOUT_REGION,
) -> DataFrame:
    return region_problems(gauges, rain_regions, expected, without_region)


def station_region_problems(
    stations: DataFrame, regions: DataFrame, expected: Sequence[str] = S.REGION_IDS,
    without_region: int = S.STATIONS_WITHOUT_REGION,
) -> DataFrame:
    return region_problems(stations, regions, expected, without_region)


def bad_locations(samples: DataFrame) -> DataFrame:
    """Locations other than surface and bottom (missing included) with their number of rows."""
    return samples.filter(_bad_location()).groupBy("location").agg(F.count("*").alias("n"))


def without_region_share(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """Readings and stations that region views leave out because the station has no region."""
    per_station = samples.groupBy(*_STATION).agg(F.count("*").alias("_n"))
    bare = stations.filter("WBID IS NULL").select(*_STATION).distinct()
    return join_on(per_station, bare, _STATION, "left_semi").agg(
        F.count_distinct(build_key(F.col("waterbody"), F.col("station"))).alias("n_stations"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_samples"),
    )


def sample_profile(samples: DataFrame) -> DataFrame:
    """The distinct places, parameters, units and locations of the readings with their number of rows and of valid rows.

    Every check of distinct values gives the same violations on the profile, which
    is counted in one pass over the readings and as small as a catalogue.
    """
    return samples.groupBy("type", "county", *_STATION, "parameter", "units", "location").agg(
        F.count("*").alias("n"), F.count(F.when(present(F.col("val")), 1)).alias("n_valid")
    )


def profile_labels(profile: DataFrame) -> DataFrame:
    """Parameters that have valid readings and a label, off the profile."""
    label = parameter_label(F.col("parameter"), F.col("units"))
    return profile.filter((F.col("n_valid") > 0) & label.isNotNull()).select("parameter").distinct()


def audit(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check: its name, the number of violations, and whether it passed."""
    out = None
    for name, df in checks.items():
        row = df.agg(F.count("*").alias("violations")).select(
            F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed")
        )
        out = row if out is None else out.unionByName(row)
    return out
