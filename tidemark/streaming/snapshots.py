"""Batch folders of changed rows, folded into a snapshot per period.

``path/batch=N`` holds the rows that batch N changed. ``fold`` merges finished
batches into ``path/_snapshots/VERSION/period=P``, one row per key, rewriting
only the periods that the batches touch, and then writes the manifest
``path/_manifests/VERSION``, which names the folder of each period and the last
batch folded. The manifest appears whole or not at all, and everything it names
is written before: a fold that dies leaves the earlier version in force. Readers
take the newest manifest and the batches after it, so they open as many folders
as there are periods and batches not yet folded, however many batches ran. What
the newest manifest and the one before it name stays; the rest is removed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import folders

EMPTY = {"version": 0, "upto": -1, "periods": {}, "schema": None}


def manifest(spark: SparkSession, path: str, before: int = 0) -> dict:
    """The newest manifest, or the one so many versions before it."""
    found = [n for n in folders.names(spark, f"{path}/_manifests") if n.isdigit()]
    return json.loads(folders.read_text(spark, f"{path}/_manifests/{found[-1 - before]}")) if len(found) > before else EMPTY


def finished_batches(spark: SparkSession, path: str, after: int = -1, below: int | None = None) -> list[int]:
    """Numbers of the batch folders that were written to their end."""
    found = sorted(int(n.removeprefix("batch=")) for n in folders.names(spark, path) if n.startswith("batch="))
    return [b for b in found if b > after and (below is None or b < below) and folders.exists(spark, f"{path}/batch={b}/_SUCCESS")]


def _batches(spark: SparkSession, path: str, numbers: Sequence[int]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in numbers]).withColumn("batch", F.col("batch").cast("long"))


def _snapshot(spark: SparkSession, path: str, known: dict, periods: Sequence[str]) -> DataFrame:
    """Rows of the listed periods, with the batch each came from."""
    schema = T.StructType.fromJson(json.loads(known["schema"]))
    paths = [f"{path}/_snapshots/{known['periods'][p]}/period={p}" for p in periods]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    one = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, "batch"), "batch").alias("_row"))
    return one.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*rest, "batch"]])


def fold(spark: SparkSession, path: str, keys: Sequence[str], period: Column, below: int | None = None) -> dict:
    """Merge the finished batches, or those below a number, into a new version; return its manifest.

    ``period`` is computed from a row's keys, so that all versions of a row fall into one period.
    """
    known = manifest(spark, path)
    tail = finished_batches(spark, path, known["upto"], below)
    if not tail:
        return known
    changed = _newest(_batches(spark, path, tail), keys)
    named = F.coalesce(F.date_format(period, "yyyy-MM-dd"), F.lit("none"))
    touched = [r[0] for r in changed.select(named).distinct().collect()]
    both = changed
    if old := sorted(set(touched) & set(known["periods"])):
        both = _newest(changed.unionByName(_snapshot(spark, path, known, old)), keys)
    version = known["version"] + 1
    both.withColumn("period", named).repartition("period").write.mode("overwrite").partitionBy("period").parquet(f"{path}/_snapshots/{version}")
    new = {"version": version, "upto": tail[-1], "periods": {**known["periods"], **dict.fromkeys(touched, version)}, "schema": both.schema.json()}
    folders.write_whole(spark, f"{path}/_manifests/{version:012d}", json.dumps(new))
    _remove_unnamed(spark, path)
    return new


def _remove_unnamed(spark: SparkSession, path: str) -> None:
    new, old = manifest(spark, path), manifest(spark, path, 1)
    used = {*new["periods"].values(), *old["periods"].values()}
    for v in folders.names(spark, f"{path}/_snapshots"):
        if v.isdigit() and int(v) < new["version"] and int(v) not in used:
            folders.remove(spark, f"{path}/_snapshots/{v}")
    for n in folders.names(spark, path):
        if n.startswith("batch=") and int(n.removeprefix("batch=")) <= old["upto"]:
            folders.remove(spark, f"{path}/{n}")
    for n in folders.names(spark, f"{path}/_manifests")[:-2]:
        folders.remove(spark, f"{path}/_manifests/{n}")


def newest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row per key. Rows of the snapshot that no later batch changed are passed on without a shuffle."""
    known = manifest(spark, path)
    tail = finished_batches(spark, path, known["upto"])
    if not tail:
        return _snapshot(spark, path, known, sorted(known["periods"])).drop("batch")
    changed = _newest(_batches(spark, path, tail), keys).drop("batch")
    if not known["periods"]:
        return changed
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    old = _snapshot(spark, path, known, sorted(known["periods"])).drop("batch")
    kept = old.alias("s").join(changed.select(*keys).alias("c"), same, "left_anti")
    return kept.unionByName(changed)
