"""Saved daily-precipitation payloads: one JSON document per station and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAYLOAD = "results array<struct<station:string,date:string,datatype:string,value:double>>"


def read_rain_payloads(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Daily rain rows (station, date, value); a document without results adds none.

    A folder of documents reads in parallel and concatenates itself.
    ``multi_line=False`` reads one document per line.
    """
    doc = spark.read.schema(_PAYLOAD).option("multiLine", multi_line).json(path)
    r = doc.select(F.explode("results").alias("r"))
    return r.select(
        F.col("r.station").alias("station"),
        F.to_date(F.substring("r.date", 1, 10)).alias("date"),
        F.col("r.value").alias("value"),
    )
