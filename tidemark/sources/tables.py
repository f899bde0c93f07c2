"""The saved tables: parquet, samples partitioned by parameter."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S


def save_table(df: DataFrame, folder: str, name: str) -> str:
    """Overwrite one table of the model.

    Samples are partitioned by parameter, which nearly every query fixes. The
    rows are rebalanced by parameter before writing: adaptive execution merges
    small parameters into one writer and splits a large one over many, so files
    have an even size however the readings are distributed.
    """
    path = os.path.join(folder, f"{name}.parquet")
    cols = [f.name for f in S.TABLES[name].fields] if name in S.TABLES else df.columns
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    out = df.select(*cols)
    if name == "samples":
        spread = out.hint("rebalance", F.col("parameter"))
        spread.sortWithinPartitions("parameter", "location", "waterbody", "station", "date").write.mode(
            "overwrite"
        ).partitionBy("parameter").parquet(path)
    else:
        out.write.mode("overwrite").parquet(path)
    return path


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the model with its declared schema and column order."""
    df = spark.read.schema(S.TABLES[name]).parquet(os.path.join(folder, f"{name}.parquet"))
    return df.select(*[f.name for f in S.TABLES[name].fields])


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(S.TABLES)) -> dict[str, DataFrame]:
    return {n: load_table(spark, folder, n) for n in names}
