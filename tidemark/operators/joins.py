"""Equi-joins in which a missing key matches a missing key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_on(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] | Mapping[str, str],
    how: str = "inner",
    null_safe: bool = True,
) -> DataFrame:
    """Join and keep one copy of the key columns (the left one).

    ``keys`` are names, or left-name to right-name. No hint is given here: a
    table scan or a hinted frame broadcasts by its known size, all else
    shuffles and may be split by adaptive execution.
    """
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    l, r = left.alias("_l"), right.alias("_r")

    def same(a: str, b: str) -> Column:
        x, y = F.col(f"_l.{a}"), F.col(f"_r.{b}")
        return x.eqNullSafe(y) if null_safe else x == y

    on = reduce(lambda a, b: a & b, [same(a, b) for a, b in pairs.items()])
    joined = l.join(r, on, how)
    if how in ("left_anti", "left_semi"):
        return joined
    extra = [c for c in right.columns if c not in pairs.values()]
    return joined.select("_l.*", *[F.col(f"_r.{c}") for c in extra])


def exclude(df: DataFrame, unwanted: DataFrame, keys: Sequence[str] = ("waterbody", "station")) -> DataFrame:
    """Drop rows whose keys are listed."""
    return join_on(df, unwanted.select(*keys).distinct(), keys, "left_anti")


def attach_notes(long: DataFrame, notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring notes to matching rows; both sides are de-duplicated, two notes for one key fan out."""
    base = long.drop("notes").distinct()
    return join_on(base, notes.select(*keys, "notes").distinct(), keys, "left")


def with_station_info(df: DataFrame, stations: DataFrame, how: str = "inner") -> DataFrame:
    """Attach station columns by (waterbody, station); ``inner`` drops unknown stations."""
    return join_on(df, stations, ["waterbody", "station"], how)


def with_region(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Keep only rows of a known region and attach its columns."""
    return join_on(df, regions, ["WBID", "WATERBODY_NAME"], "inner")


def with_gauge(rain: DataFrame, gauges: DataFrame, how: str = "inner") -> DataFrame:
    """Attach gauge columns to rain rows by (station, name)."""
    return join_on(rain, gauges, ["station", "name"], how)


def with_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(parameter, location) pairs with every label of the parameter; several labels fan out."""
    return join_on(pairs, labels.select("parameter", "labelnouni").distinct(), ["parameter"], "left")


def station_grid(stations: DataFrame, kinds: Sequence[str], name: str = "type") -> DataFrame:
    """Each station once per kind of series: a short literal list exploded, not a join."""
    keys = stations.select("waterbody", "station").distinct()
    return keys.withColumn(name, F.explode(F.array(*[F.lit(k) for k in kinds])))
