"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, save


def _least(pairs: DataFrame) -> DataFrame:
    """(a, m): the smallest b of every a, or a itself. No broadcast: the driver holds no part of a graph."""
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).hint("merge")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of an id, linked with the least of the id and its neighbours. edges: a > b."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    linked = back.join(_least(edges.union(back)), "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every id and its smaller neighbours, linked with the least of them. edges: a > b."""
    least = _least(edges)
    linked = edges.join(least, "a").select("b", "m").union(least)
    return linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b) that isn't its component's smallest.

    A hub's neighbours are never gathered: each round takes grouped minima and
    joins them back, and each half of a round is written to shared storage, so
    that no plan holds one star several times in another. Rounds grow with the
    logarithm of the longest chain. Equal, null or empty edges are
    allowed.
    """
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        for star in (_large, _small):
            nxt = save(star(e), "stars")
            drop(e)
            e = nxt
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
        mark = seen
