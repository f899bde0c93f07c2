from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import ordered, spatial
from tidemark.sources.polygons import tidy_rings, with_box


def skewed(spark, n=6000):
    """One series holds most of the rows, one has a NULL key."""
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.8 else rnd.choice(["a", "b", None]), i, round(rnd.lognormvariate(0, 1), 2)) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, seq int, v double").repartition(7)


def test_running_sum_and_previous_against_brute_force(spark):
    data, df = skewed(spark)
    out = ordered.running_sum(df.withColumn("c", F.col("seq").cast("int") / 500 - (F.col("seq") / 500) % 1), ["k"], "c", "seq", "v", "total")
    got = {(r["k"], r["seq"]): r["total"] for r in out.collect()}
    prev = ordered.previous_value(df, ["k"], F.floor(F.col("seq") / 500), "seq", "v", "before")
    before = {(r["k"], r["seq"]): r["before"] for r in prev.collect()}
    assert len(got) == len(before) == len(data)
    total, last = {}, {}
    for k, i, v in data:
        total[k] = total.get(k, 0.0) + v
        assert got[(k, i)] == pytest.approx(total[k])
        assert before[(k, i)] == last.get(k)
        last[k] = v


def test_images_are_the_bits_of_doubles(spark):
    rnd = random.Random(6)
    vs = [0.0, -0.0, float("inf"), -float("inf"), 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308]
    for e in range(-1074, 1024):
        x = 2.0**e
        vs += [x, float(np.nextafter(x, 0)), float(np.nextafter(x, np.inf)), -x * (1 + rnd.random())]
    df = spark.createDataFrame([(v,) for v in vs], "v double").select("v", ordered.order_image(F.col("v")).alias("i"))
    got = df.select("v", "i", ordered.double_of_image(F.col("i")).alias("b")).collect()
    for v, i, b in got:
        bits = int(np.float64(abs(v)).view(np.int64))
        assert i == (-bits if v < 0 else bits) and b == v, v
    order = sorted(got, key=lambda r: r["i"])
    assert [r["v"] for r in order] == sorted(vs)


@pytest.mark.parametrize("few", [0, 3, 1 << 16])
def test_exact_quantiles_against_numpy(spark, few, monkeypatch):
    monkeypatch.setattr(ordered, "FEW", few)
    data, df = skewed(spark)
    data = data + [("a", 0, v) for v in (-1e300, -0.5, -0.5, 0.0, 5e-324)]
    df = df.unionByName(spark.createDataFrame(data[-5:], df.schema)).unionByName(spark.createDataFrame([("a", 0, None), ("a", 0, float("nan")), ("gone", 0, None)], df.schema))
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    out = ordered.exact_quantiles(df, ["k"], "v", probs).collect()
    assert {r["k"] for r in out} == {"hot", "a", "b", None}
    for r in out:
        vs = [v for k, _, v in data if k == r["k"]]
        assert r["n"] == len(vs)
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(vs, probs).tolist())


def test_a_million_values_in_one_bin(spark, monkeypatch):
    """All values share their upper 32 bits; still no bin that is ordered holds more than FEW of them."""
    n, step = 1_000_000, 2.0**-52
    df = spark.range(n).select(F.lit("g").alias("k"), (F.lit(1.0) + F.pmod(F.col("id") * 7919, F.lit(n)) * F.lit(step)).alias("v"))
    left = []

    def seen(images, keys, probs, bins=ordered._bins_of_ranks):
        target, bits = bins(images, keys, probs)
        left.append((target.agg(F.max("_c")).first()[0], bits))
        return target, bits

    monkeypatch.setattr(ordered, "_bins_of_ranks", seen)
    r = ordered.exact_quantiles(df, ["k"], "v", (0.0, 0.5, 1.0)).first()
    assert (r["n"], r["q0"], r["q2"]) == (n, 1.0, 1.0 + (n - 1) * step) and 0 < r["q1"] - 1.0 - (n / 2 - 0.5) * step <= step
    assert left[0][0] <= ordered.FEW and left[0][1] == 16


def test_quantile_reference_values(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 10.0)], "k string, v double")
    r = ordered.exact_quantiles(df, ["k"], "v", (0.25, 0.5, 0.75)).first()
    assert (r["q0"], r["q1"], r["q2"]) == (1.75, 2.5, 4.75)


def regions(spark, named):
    rows = [(i, i.lower(), [[(float(x), float(y)) for x, y in ring] for ring in rings]) for i, rings in named.items()]
    df = spark.createDataFrame(rows, "WBID string, WATERBODY_NAME string, rings array<array<struct<x:double,y:double>>>")
    return with_box(df.withColumn("rings", tidy_rings(F.col("rings"))))


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


def test_inside_outside_edge_hole(spark, rows):
    reg = regions(spark, {"A": [SQUARE, [(1, 1), (2, 1), (2, 2), (1, 2)]]})
    pts = spark.createDataFrame(
        [("in", 3.0, 3.0), ("out", 5.0, 3.0), ("edge", 4.0, 3.0), ("corner", 0.0, 0.0), ("hole", 1.5, 1.5), ("rim", 1.0, 1.5), ("none", None, None)],
        "p string, lon double, lat double",
    )
    got = dict(rows(spatial.locate(pts, reg), "p", "WBID"))
    assert got == {"in": "A", "out": None, "edge": "A", "corner": "A", "hole": None, "rim": "A", "none": None}


def test_many_rows_at_one_place_and_overlaps(spark, rows):
    reg = regions(spark, {"A": [SQUARE], "B": [[(2, 2), (6, 2), (6, 6), (2, 6)]], "far": [[(50, 50), (51, 50), (51, 51)]]})
    pts = spark.createDataFrame([(i, 3.0, 3.0) for i in range(50)] + [(99, 9.0, 9.0)], "p int, lon double, lat double")
    out = spatial.locate(pts, reg)
    assert out.count() == 101 and out.filter("WBID IS NULL").count() == 1
    assert rows(spatial.regions_with_points(reg, pts), "WBID") == [("A",), ("B",)]


def inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("size", [0.05, 0.3, 5.0])
def test_random_polygons_against_brute_force(spark, size):
    rnd = random.Random(5)
    named = {}
    for i in range(12):
        cx, cy = rnd.uniform(-2, 2), rnd.uniform(-2, 2)
        angles = sorted(rnd.uniform(0, 6.283) for _ in range(9))
        named[f"P{i}"] = [[(cx + rnd.uniform(0.2, 1.2) * np.cos(a), cy + rnd.uniform(0.2, 1.2) * np.sin(a)) for a in angles]]
    pts = [(i, rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for i in range(400)]
    want = {(i, n) for i, x, y in pts for n, (ring,) in named.items() if inside(ring, x, y)}
    df = spark.createDataFrame(pts, "p int, lon double, lat double")
    out = spatial.locate(df, regions(spark, named), size=size)
    assert {(r["p"], r["WBID"]) for r in out.collect() if r["WBID"]} == want
    assert {r["p"] for r in out.select("p").collect()} == set(range(400))  # every point keeps a row


def test_ring_of_many_edges(spark):
    """20,000 edges inside one grid row: a point meets few of them, and the answer stays right."""
    n, r = 20_000, 0.01
    ring = [(0.02 + r * np.cos(2 * np.pi * i / n), 0.02 + r * np.sin(2 * np.pi * i / n)) for i in range(n)]
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(0.009, 0.031), rnd.uniform(0.009, 0.031)) for i in range(200)]
    df, reg = spark.createDataFrame(pts, "p int, lon double, lat double"), regions(spark, {"round": [ring]})
    assert spatial.polygon_edges(reg).count() < 3 * n
    met = spatial.cells_met(df, reg).withColumn("_row", F.floor(F.col("_y") / F.col("_height"))).join(spatial.polygon_edges(reg), ["_pid", "_row"])
    assert met.count() < 50 * len(pts)
    got = {r["p"] for r in spatial.locate(df, reg).filter("WBID = 'round'").collect()}
    assert got == {i for i, x, y in pts if inside(ring, x, y)}


def star(n, cx, cy, far):
    """A ring of n corners at changing distances."""
    rnd = random.Random(n)
    at = [far * (0.55 + 0.45 * rnd.random()) for _ in range(n)]
    return [(cx + d * np.cos(2 * np.pi * i / n), cy + d * np.sin(2 * np.pi * i / n)) for i, d in enumerate(at)]


def test_cover_follows_the_outline(spark):
    """Twice the size: about twice the rows, where the box has four times the cells."""
    rows = {}
    for far in (10, 20):
        reg = regions(spark, {"P": [star(40, 3.0, -2.0, far)]})
        got = spatial.polygon_cells(reg).groupBy("_outline").count().collect()
        rows[far] = {r["_outline"]: r["count"] for r in got}
        box = (2 * far / spatial.CELL) ** 2
        assert sum(rows[far].values()) < 0.1 * box
    assert rows[20][True] < 2.2 * rows[10][True] and rows[20][False] < 2.4 * rows[10][False]


def test_points_inside_meet_no_edge(spark):
    ring = star(60, -84.0, 30.0, 6)
    reg = regions(spark, {"P": [ring, [(-84.5, 29.5), (-83.5, 29.5), (-83.5, 30.5), (-84.5, 30.5)]], "Q": [[(-85, 29), (-80, 29), (-80, 33)]]})
    rnd = random.Random(8)
    pts = [(i, rnd.uniform(-91, -77), rnd.uniform(23, 37)) for i in range(3000)] + [(3000, -84.5, 30.0), (3001, -83.5, 30.5), (3002, -85.0, 29.0), (3003, -80.0, 31.0)]
    df = spark.createDataFrame(pts, "p int, lon double, lat double")
    hole = lambda x, y: -84.5 < x < -83.5 and 29.5 < y < 30.5
    want = {(i, "P") for i, x, y in pts[:3000] if inside(ring, x, y) and not hole(x, y)} | {(i, "Q") for i, x, y in pts[:3000] if inside([(-85, 29), (-80, 29), (-80, 33)], x, y)}
    want |= {(3000, "P"), (3001, "P"), (3001, "Q"), (3002, "P"), (3002, "Q"), (3003, "Q")}
    got = {(r["p"], r["WBID"]) for r in spatial.locate(df, reg).filter("WBID IS NOT NULL").collect()}
    assert {g for g in got if g[0] < 3000} == {x for x in want if x[0] < 3000} and {(3000, "P"), (3001, "P"), (3003, "Q")} <= got
    met = spatial.cells_met(df, reg).groupBy("_outline").count().collect()
    assert {r["_outline"]: r["count"] for r in met}[True] < 0.1 * len(pts)


def test_resolve_multiple(spark, rows):
    df = spark.createDataFrame(
        [("a", "1", "X", "X"), ("a", "1", "Y", "X"), ("b", "1", "X", "Z"), ("b", "1", "Y", "Z"), ("c", "1", None, "Q"), ("d", "1", "W", "Q"), ("e", "1", None, "Q"), ("e", "1", None, "Q")],
        "waterbody string, station string, WBID string, WBIDorig string",
    )
    assert rows(spatial.resolve_multiple(df), "waterbody", "WBID") == [("a", "X"), ("c", None), ("d", "W")]
    assert rows(spatial.unresolved(df)) == [("b", "1"), ("e", "1")]


def test_box(spark, rows):
    b = S.STATION_BOX
    pts = spark.createDataFrame([("in", b["xmin"], b["ymin"]), ("near", b["xmin"] - 0.005, b["ymin"]), ("none", None, 1.0)], "p string, lon double, lat double")
    assert rows(spatial.in_box(pts, b), "p") == [("in",)]
    assert rows(spatial.in_box(pts, b, 0.01), "p") == [("in",), ("near",)]
    assert rows(spatial.outside_box(pts, b), "p") == [("near",), ("none",)]
