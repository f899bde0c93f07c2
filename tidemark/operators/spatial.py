"""Points in polygons by grid-cell equi-joins and edge crossings; no geometry library.

Only distinct coordinates are tested, so many rows at one place cost one test.
Each polygon is covered by a quadtree: the smallest cells where its outline
passes, and ever larger ones where it lies whole inside. Rows per polygon follow its
outline, not its box, and a point in an inner cell is a hit without a look at any
edge. Points in cells of the outline are tested against edges. The edges of a polygon lie in rows as high as its mean
edge: an edge passes two or three of them on average, so the rows stay linear in
the edges, and a point meets about twice the edges that a line through it crosses,
however many edges a ring has. Crossings are counted by a grouped
aggregate, which is combined before the shuffle. Holes and the parts of a
multi-polygon follow from the even-odd rule. A point on an edge counts as inside.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import join_on
from tidemark.session import saved

CELL = 0.05  # degrees


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size))


def _identified(regions: DataFrame) -> DataFrame:
    return regions.withColumn("_pid", F.xxhash64("WBID", "WATERBODY_NAME", "rings"))


def _row_height(rings: Column) -> Column:
    """Mean height of a polygon's edges; 1 where all of them are level."""
    heights = F.flatten(
        F.transform(
            rings,
            lambda r: F.zip_with(
                F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.abs(a["y"] - b["y"])
            ),
        )
    )
    mean = F.aggregate(heights, F.lit(0.0), lambda s, h: s + h) / F.size(heights)
    return F.when(mean > 0, mean).otherwise(F.lit(1.0))


def _edges(regions: DataFrame) -> DataFrame:
    """One row per polygon edge: ``_pid``, row height, the longer side of the polygon's box, ends."""
    kept = ("_pid", "_height", "_wide")
    rings = _identified(regions).dropDuplicates(["_pid"]).select(
        "_pid", _row_height(F.col("rings")).alias("_height"), F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")).alias("_wide"),
        F.explode("rings").alias("r"),
    )
    ends = rings.select(*kept, F.explode(F.arrays_zip(F.expr("slice(r, 1, size(r) - 1) as a"), F.expr("slice(r, 2, size(r) - 1) as b"))).alias("e"))
    return ends.selectExpr(*kept, "e.a.x AS x1", "e.a.y AS y1", "e.b.x AS x2", "e.b.y AS y2")


def _by_row(edges: DataFrame) -> DataFrame:
    lo, hi = (F.floor(y / F.col("_height")) for y in (F.least("y1", "y2"), F.greatest("y1", "y2")))
    return edges.withColumn("_row", F.explode(F.sequence(lo, hi)))


def polygon_edges(regions: DataFrame) -> DataFrame:
    """One row per polygon edge and edge row (``_row``) it passes."""
    return _by_row(_edges(regions))


def _outline(edges: DataFrame, size: float) -> DataFrame:
    """Smallest cells that a polygon's outline passes, once for every edge that does (``_pid``, ``_height``, ``_wide``, ``_gx``, ``_gy``).

    An edge is cut by the rows of cells; in each it passes those between its ends
    there. A millionth of a cell is added on every side for rounding: a cell too many
    costs a test, one too few would be wrong.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    spare = F.lit(size * 1e-6)
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    rows = edges.withColumn("_gy", F.explode(F.sequence(_cell(low - spare, size), _cell(high + spare, size))))

    def at(y: Column) -> Column:
        return F.when(y1 == y2, x1).otherwise(x1 + (y - y1) * (x2 - x1) / (y2 - y1))

    bottom = F.greatest(low, F.col("_gy") * F.lit(size) - spare)
    top = F.least(high, (F.col("_gy") + 1) * F.lit(size) + spare)
    a, b = at(bottom), F.when(y1 == y2, x2).otherwise(at(top))
    left = F.greatest(F.least(a, b), F.least(x1, x2)) - spare
    right = F.least(F.greatest(a, b), F.greatest(x1, x2)) + spare
    return rows.select("_pid", "_height", "_wide", "_gy", F.explode(F.sequence(_cell(left, size), _cell(right, size))).alias("_gx"))


def polygon_cells(regions: DataFrame, size: float = CELL) -> DataFrame:
    """The quadtree cover: ``_pid``, ``_level``, ``_gx``, ``_gy``, ``_height``, ``_outline``; a cell of level k is 2**k small cells wide.

    A cell with outline inside is parted in four until it is a smallest one. What
    holds none is whole inside or whole outside, which its centre tells. The largest
    cells are those of which the polygon's box meets at most two a side, so the
    outline passes all of them that the polygon touches.
    """
    return _cover(_edges(regions), size)


def _cover(edges: DataFrame, size: float) -> DataFrame:
    keys = ("_pid", "_height", "_level", "_gx", "_gy")
    # a box of n cells a side meets at most n + 2 of them, and one more by rounding
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("_wide") / F.lit(size) + 3)).cast("int"))
    parted = _outline(edges, size).withColumn("_level", F.explode(levels)).selectExpr("_pid", "_height", "_level", "shiftright(_gx, _level) AS _gx", "shiftright(_gy, _level) AS _gy").distinct()
    quarters = parted.filter("_level > 0").selectExpr("_pid", "_height", "_level - 1 AS _level", "_gx", "_gy", "explode(sequence(0, 3)) AS _q").selectExpr(
        "_pid", "_height", "_level", "_gx * 2 + _q % 2 AS _gx", "_gy * 2 + _q div 2 AS _gy"
    )
    known = parted.withColumn("_outline", F.lit(True)).unionByName(quarters.withColumn("_outline", F.lit(False)))
    cells = known.groupBy(*keys).agg(F.bool_or("_outline").alias("_outline"))
    centre = lambda c: (F.col(c) + 0.5) * F.pow(F.lit(2.0), "_level") * F.lit(size)
    inner = _contained(cells.filter(~F.col("_outline")).withColumns({"_x": centre("_gx"), "_y": centre("_gy")}), edges, keys)
    smallest = cells.filter("_outline AND _level = 0")
    return smallest.unionByName(inner.withColumn("_outline", F.lit(False))).select("_pid", "_level", "_gx", "_gy", "_height", "_outline")


def _contained(places: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of places (``_pid``, ``_height``, ``_x``, ``_y``), one per keys, those that lie inside their polygon or on its outline."""
    x, y = F.col("_x"), F.col("_y")
    met = places.withColumn("_row", F.floor(y / F.col("_height"))).join(_by_row(edges).drop("_height", "_wide"), ["_pid", "_row"])
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    on_edge = (
        ((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1))
        & x.between(F.least(x1, x2), F.greatest(x1, x2))
        & y.between(F.least(y1, y2), F.greatest(y1, y2))
    )
    counted = met.groupBy(*keys).agg(F.count(F.when(crosses, 1)).alias("_crossings"), F.count(F.when(on_edge, 1)).alias("_touches"))
    return counted.filter((F.col("_crossings") % 2 == 1) | (F.col("_touches") > 0)).drop("_crossings", "_touches")


def cells_met(points: DataFrame, regions: DataFrame, lon: str = "lon", lat: str = "lat", size: float = CELL) -> DataFrame:
    """Distinct coordinates (``_x``, ``_y``) with the cells of polygons that they lie in."""
    return _met(points, _edges(regions), lon, lat, size)


def _met(points: DataFrame, edges: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    cells = saved(_cover(edges, size), "cover")
    levels = cells.select(F.collect_set("_level")).scalar()
    coords = (
        points.select(F.col(lon).alias("_x"), F.col(lat).alias("_y"))
        .filter("_x IS NOT NULL AND _y IS NOT NULL")
        .distinct()
        .withColumn("_level", F.explode(levels))
        .withColumns({f"_g{c}": F.expr(f"shiftright({_small(c, size)}, _level)") for c in ("x", "y")})
    )
    return coords.join(cells, ["_level", "_gx", "_gy"])


def _small(c: str, size: float) -> str:
    return f"floor(_{c} / {size!r}D)"


def region_hits(points: DataFrame, regions: DataFrame, lon: str = "lon", lat: str = "lat", size: float = CELL) -> DataFrame:
    """Distinct (lon, lat, _pid) pairs of coordinates and the polygons that contain them."""
    edges = saved(_edges(regions), "edges")  # the layer is read once, not for each of the three uses of its edges
    met = _met(points, edges, lon, lat, size)
    inner = met.filter(~F.col("_outline")).select("_x", "_y", "_pid")
    tested = _contained(met.filter("_outline").select("_x", "_y", "_pid", "_height"), edges, ["_x", "_y", "_pid"])
    return inner.unionByName(tested).select(F.col("_x").alias(lon), F.col("_y").alias(lat), "_pid")


def locate(points: DataFrame, regions: DataFrame, lon: str = "lon", lat: str = "lat", size: float = CELL) -> DataFrame:
    """Every point with the region that contains it: one row per region hit, NULL region if none."""
    names = _identified(regions).select("_pid", "WBID", "WATERBODY_NAME")
    named = region_hits(points, regions, lon, lat, size).join(names, "_pid").drop("_pid")
    return join_on(points.drop("WBID", "WATERBODY_NAME"), named, [lon, lat], "left")


def regions_with_points(regions: DataFrame, points: DataFrame, lon: str = "lon", lat: str = "lat", size: float = CELL) -> DataFrame:
    """The regions that contain at least one point."""
    hit = region_hits(points, regions, lon, lat, size).select("_pid").distinct()
    return _identified(regions).join(hit, "_pid", "left_semi").drop("_pid")


def resolve_multiple(
    located: DataFrame, keys: Sequence[str] = ("waterbody", "station"), recorded: str = "WBIDorig"
) -> DataFrame:
    """Stations found in several regions keep the one first recorded for them.

    If none equals it (or the region is missing), the station is dropped. ``located``
    holds one row per station and region hit, so a window over a station is short,
    and the spatial join before it is planned once.
    """
    tagged = located.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    wrong = (F.col("_n") > 1) & (F.col("WBID") != F.col(recorded))
    return tagged.filter(~wrong).drop("_n", recorded)


def unresolved(located: DataFrame, keys: Sequence[str] = ("waterbody", "station"), recorded: str = "WBIDorig") -> DataFrame:
    """Station keys that ``resolve_multiple`` drops altogether."""
    counts = located.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count(F.when(F.col("WBID") == F.col(recorded), 1)).alias("_same")
    )
    return counts.filter("_n > 1 AND _same = 0").select(*keys)


def in_box(points: DataFrame, box: Mapping[str, float], buffer: float = 0.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return points.filter(_inside(box, buffer, lon, lat))


def outside_box(points: DataFrame, box: Mapping[str, float], buffer: float = 0.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points outside the rectangle, or without coordinates."""
    return points.filter(~F.coalesce(_inside(box, buffer, lon, lat), F.lit(False)))


def _inside(box: Mapping[str, float], buffer: float, lon: str, lat: str) -> Column:
    return F.col(lon).between(box["xmin"] - buffer, box["xmax"] + buffer) & F.col(lat).between(
        box["ymin"] - buffer, box["ymax"] + buffer
    )
