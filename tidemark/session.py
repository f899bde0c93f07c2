"""Spark session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    Timestamps are read in UTC. Adaptive execution coalesces small shuffle
    partitions and splits skewed ones, so the shuffle partition count only has
    to be an upper bound.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # no Python call site is recorded per column: half the time it takes to build a long plan
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    ``spark.checkpoint.dir`` names storage every executor can reach. Only where
    it is unset, in a session of one machine, is a local temporary folder used;
    on a cluster that is an error, for other machines would not see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a small intermediate result to shared storage and read it back.

    For results of one row per series that go back to every reading. Computed
    once, it survives the loss of executors, and as a table it has a known
    size: Catalyst broadcasts it if that is small and shuffles it if not. Left
    inside the plan, its size would be unknown and all readings would be
    shuffled to meet it.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
