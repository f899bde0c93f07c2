"""Rain roll-ups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import dates
from tidemark.functions.values import recode
from tidemark.operators.filters import wet_days
from tidemark.operators.joins import join_on
from tidemark.operators.ordered import exact_quantiles
from tidemark.session import saved


def month_total(column: str = "precip_inches") -> Column:
    """Sum of a month; missing values, NaN among them, are left out and a month of them totals zero."""
    return F.coalesce(F.sum(F.when(~F.isnan(column), F.col(column))), F.lit(0.0))


def rain_monthly(daily: DataFrame, names: Mapping[str, str] = S.RAIN_STATIONS) -> DataFrame:
    """Monthly totals per gauge from daily rows (station, date, value); ids lose their prefix,
    gauges outside ``names`` get a NULL name."""
    bare = F.regexp_replace("station", S.RAIN_STATION_PREFIX, "")
    name = F.when(bare.isin(*names), recode(bare, names))
    return monthly_totals(
        daily.select(bare.alias("station"), name.alias("name"), "date", F.col("value").alias("precip_inches"))
    )


def monthly_totals(daily: DataFrame) -> DataFrame:
    """Monthly totals from named daily rows; a month of missing values totals zero."""
    return daily.groupBy("station", "name", dates.month_floor(F.col("date")).alias("date")).agg(
        month_total().alias("precip_inches")
    )


def monthly_by_part(daily: DataFrame) -> DataFrame:
    """Totals keyed by year and month, with the month's first day as date."""
    d = F.col("date")
    return daily.groupBy("station", F.year(d).alias("year"), F.month(d).alias("month")).agg(
        month_total().alias("monthly_total"), dates.month_floor(F.min(d)).alias("date")
    )


def rain_distribution(daily: DataFrame, key: str = "station") -> DataFrame:
    """Box-plot figures of wet days per gauge: quartiles, whiskers (the furthest values within 1.5
    interquartile ranges) and the number of values beyond them."""
    wet = wet_days(daily)
    q = saved(exact_quantiles(wet, [key], "precip_inches", (0.25, 0.5, 0.75)), "quartiles")
    reach = (F.col("q2") - F.col("q0")) * F.lit(1.5)
    fences = q.select(key, "n", "q0", "q1", "q2", (F.col("q0") - reach).alias("_lo"), (F.col("q2") + reach).alias("_hi"))
    tagged = join_on(wet.select(key, "precip_inches"), fences, [key], "inner")
    v = F.col("precip_inches")
    inside = v.between(F.col("_lo"), F.col("_hi"))
    return tagged.groupBy(key, "n", "q0", "q1", "q2").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count(F.when(~inside, v)).alias("n_outliers"),
    ).withColumnsRenamed({"q0": "q25", "q1": "median", "q2": "q75"})


def rain_outliers(daily: DataFrame, key: str = "station") -> DataFrame:
    """The wet days beyond the whiskers."""
    box = saved(rain_distribution(daily, key).select(key, "whisker_low", "whisker_high"), "whiskers")
    tagged = join_on(wet_days(daily), box, [key], "inner")
    v = F.col("precip_inches")
    return tagged.filter((v < F.col("whisker_low")) | (v > F.col("whisker_high"))).select(key, "date", "precip_inches")
