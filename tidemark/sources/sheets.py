"""CSV sheets, read as text and typed explicitly."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions.values import null_tokens, to_number
from tidemark.session import saved

#: How cells are written: quotes inside a cell are doubled, a row of another width fails.
CSV = {"escape": '"', "mode": "FAILFAST"}


def read_text_sheet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A sheet with every column as text and the three missing-value spellings as NULL.

    ``columns`` are required; the read fails when one is absent, and when a row
    has more or fewer cells than its header. Quotes inside a cell are doubled.
    The files of a folder are put together by heading, whatever their order;
    files with different headings fail.
    """
    df = spark.read.options(header=True, inferSchema=False, **CSV).csv(path)
    if len(df.inputFiles()) > 1:
        df = _many_files(spark, path)
    missing = sorted(set(columns or ()) - set(df.columns))
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    # positional, because header names may hold dots
    raw = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return raw.select(*[null_tokens(F.col(f"c{i}")).alias(n) for i, n in enumerate(df.columns)])


def _many_files(spark: SparkSession, path: str) -> DataFrame:
    """All files in one scan of lines, each line met with the heading of its file.

    The heading is the first line of a file's first block. The plan holds a cell
    per column and order of headings, however many files there are.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth"))
    lines = read.filter("trim(value) <> ''")
    tops = lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "nth").alias("heading"))
    headings = saved(tops, "headings")
    orders = {r["heading"]: next(csv.reader([r["heading"]])) for r in headings.select("heading").distinct().collect()}
    names = max(orders.values())
    for found in orders.values():
        if sorted(found) != sorted(names):
            raise ValueError(f"{path}: files with different headings {sorted(set(found) ^ set(names))}")
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), {**CSV})
    kinds = list(orders)
    # a short number per file, since every cell of every row asks for the order of its heading
    kind = F.coalesce(*[F.when(F.col("heading") == h, F.lit(i)) for i, h in enumerate(kinds)])
    rows = lines.join(headings.withColumn("kind", kind), "file").filter("value <> heading").select("kind", cells.alias("cells"))
    at = {h: {n: i for i, n in enumerate(orders[heading])} for h, heading in enumerate(kinds)}

    def cell(name: str) -> Column:
        by_order: dict[int, list[int]] = defaultdict(list)
        for h, places in at.items():
            by_order[places[name]].append(h)
        if len(by_order) == 1:
            return F.col(f"cells.c{at[h][name]}")
        return F.coalesce(*[F.when(F.col("kind").isin(held), F.col(f"cells.c{i}")) for i, held in by_order.items()])

    return rows.select(*[cell(n).alias(f"c{i}") for i, n in enumerate(names)]).toDF(*names)


def read_field_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The wide sheet of field readings."""
    return read_text_sheet(spark, path, S.FIELD_HEADINGS)


def read_lab_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The wide sheet of laboratory results; numbers may carry remarks."""
    return read_text_sheet(spark, path, S.LAB_HEADINGS)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Stations to leave out: (waterbody, station)."""
    df = read_text_sheet(spark, path, ("waterbody", "station"))
    return df.select("waterbody", "station")


def read_criteria_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The criteria sheet with its three value columns as doubles."""
    df = read_text_sheet(spark, path, S.CRITERIA_RENAMES)
    names = S.CRITERIA_RENAMES
    return df.select(
        *[
            (to_number(F.col(f"`{old}`")) if new in S.CRITERIA_PARAMETERS else F.col(f"`{old}`")).alias(new)
            for old, new in names.items()
        ]
    )


def read_station_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The station list; both coordinate headers are exchanged in one projection."""
    df = read_text_sheet(spark, path, S.STATION_RENAMES)
    return df.select(
        *[
            (to_number(F.col(f"`{old}`")) if new in ("lon", "lat") else F.col(f"`{old}`")).alias(new)
            for old, new in S.STATION_RENAMES.items()
        ]
    )
