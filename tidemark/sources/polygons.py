"""GeoJSON features to region rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"
_PROPERTIES = "struct<WBID:string,WATERBODY_NAME:string>"
_GEOMETRY = "struct<type:string,coordinates:string>"
_FEATURE = f"properties {_PROPERTIES}, geometry {_GEOMETRY}"
_FEATURES = f"features array<struct<properties:{_PROPERTIES},geometry:{_GEOMETRY}>>"


def tidy_rings(rings: Column) -> Column:
    """Close open rings and drop those that enclose nothing (fewer than four points once closed)."""
    closed = F.transform(
        rings,
        lambda r: F.when(
            (F.size(r) > 0) & (F.element_at(r, 1) != F.element_at(r, -1)),
            F.concat(r, F.slice(r, 1, 1)),
        ).otherwise(r),
    )
    return F.filter(closed, lambda r: F.size(r) >= 4)


def with_box(df: DataFrame) -> DataFrame:
    """Add the bounding box of ``rings``."""
    pts = F.flatten(F.col("rings"))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return df.withColumns(
        {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}
    )


def region_rows(features: DataFrame) -> DataFrame:
    """(WBID, WATERBODY_NAME, type, coordinates-as-JSON) to region rows with closed rings.

    The rings of all parts of a multi-polygon lie side by side: point tests use
    the even-odd rule, under which parts and holes need no distinction. A geometry
    that is no polygon, or whose coordinates cannot be read, fails the job.
    """
    coords, strict = F.col("coordinates"), {"mode": "FAILFAST"}
    rings = (
        F.when(F.col("type") == "MultiPolygon", F.flatten(F.from_json(coords, _MULTI, strict)))
        .when(F.col("type") == "Polygon", F.from_json(coords, _POLYGON, strict))
        .otherwise(F.raise_error(F.concat(F.lit("no polygon: "), F.coalesce("type", F.lit("no geometry")))))
    )
    points = F.transform(
        rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    )
    out = features.select(
        "WBID", "WATERBODY_NAME", tidy_rings(points).alias("rings")
    )
    return with_box(out.filter(F.size("rings") > 0))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Read GeoJSON.

    By default each file is one feature collection, read by one task. With
    ``lines`` each line is one feature, so that a large layer in a single file
    is split over tasks. Broken JSON fails the job.
    """
    reader = spark.read.option("mode", "FAILFAST")
    if lines:
        features = reader.schema(_FEATURE).json(path)
    else:
        doc = reader.schema(_FEATURES).option("multiLine", True).json(path)
        features = doc.select(F.explode("features").alias("f")).select("f.*")
    return region_rows(
        features.select("properties.WBID", "properties.WATERBODY_NAME", "geometry.type", "geometry.coordinates")
    )
