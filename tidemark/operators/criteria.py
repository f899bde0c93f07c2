"""Threshold look-up: a criterion shows only where exactly one value applies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import join_on

KEYS = {"region": ("WBID",), "station": ("waterbody", "station")}


def unique_criteria(criteria: DataFrame, by: str) -> DataFrame:
    """One row per area and criterion whose value is unambiguous (smallest equals largest)."""
    keys = KEYS[by]
    agg = criteria.groupBy(*keys, "parameter").agg(F.min("value").alias("value"), F.max("value").alias("_max"))
    return agg.filter(F.col("value") == F.col("_max")).drop("_max")


def with_criterion(df: DataFrame, criteria: DataFrame, by: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Attach ``criterion``; the first three letters of the parameter choose it (both chlorophylls
    share one). ``keys`` names the area columns of ``df`` if they differ."""
    own = keys or KEYS[by]
    crit = unique_criteria(criteria, by).withColumnsRenamed(
        {**dict(zip(KEYS[by], own)), "parameter": "_p", "value": "criterion"}
    )
    tagged = df.withColumn("_p", F.substring("parameter", 1, 3))
    return join_on(tagged, crit, [*own, "_p"], "left").drop("_p")
