from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest

from tidemark.plans import queries
from tidemark.session import saved, scratch_dir

D = dt.date


@pytest.fixture(scope="module")
def rain(spark):
    r = spark.createDataFrame(
        [("G1", "Nice", D(2019, 12, 1), 1.0), ("G1", "Nice", D(2020, 1, 1), 2.0), ("G2", "Far", D(2020, 1, 1), 6.0), ("G3", "Out", D(2020, 1, 1), 9.0)],
        "station string, name string, date date, precip_inches double",
    )
    g = spark.createDataFrame(
        [("G1", "Nice", "R1", "Bay"), ("G2", "Far", "R1", "Bay"), ("G3", "Out", None, None)],
        "station string, name string, WBID string, WATERBODY_NAME string",
    )
    return r, g


def test_rain_side_is_clipped_unless_asked(rain, rows):
    r, g = rain
    side = queries.comparison_side(None, None, "region", "rain", "2020-01-01", "2020-12-31", rain=r, gauges=g)
    assert rows(side, "waterbody", "date", "val") == [("R1", D(2020, 1, 1), 4.0)]
    side = queries.comparison_side(None, None, "region", "rain", "2020-01-01", "2020-12-31", rain=r, gauges=g, clip_rain=False)
    assert rows(side, "date", "val") == [(D(2019, 12, 1), 1.0), (D(2020, 1, 1), 4.0)]


def test_rain_gauge_side_and_selection(rain, rows):
    r, g = rain
    side = queries.comparison_side(None, None, "station", "rain", period="year", rain=r, gauges=g)
    assert rows(queries.selected(side, "Nice_G1"), "date", "val", "lovl") == [(D(2019, 1, 1), 1.0, None), (D(2020, 1, 1), 2.0, None)]
    assert queries.selected(side, None).count() == 0


def test_sum_of_period_totals_is_the_total(rain, rows):
    r, g = rain
    for period in ("year", "season"):
        side = queries.comparison_side(None, None, "station", "rain", period=period, rain=r, gauges=g)
        assert sum(v for (v,) in rows(side, "val")) == 18.0


def test_trend_and_criterion_on_a_side(rain, rows, spark):
    r, g = rain
    crit = spark.createDataFrame([("w", "1", "R1", "rai", 3.0)], "waterbody string, station string, WBID string, parameter string, value double")
    side = queries.comparison_side(None, None, "region", "rain", rain=r, gauges=g)
    out = queries.comparison_series(side, side, crit, "region", "shortest")
    assert rows(out, "date", "trend", "criterion") == [(D(2019, 12, 1), pytest.approx(1.0), 3.0), (D(2020, 1, 1), pytest.approx(4.0), 3.0)]


def test_scratch_follows_the_checkpoint_folder(spark, rows):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_dir(spark, "x").startswith(str(shared))
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    df = spark.range(3)
    assert rows(saved(df, "three")) == rows(df)
    assert any(p.name.startswith("three-") for p in shared.iterdir())


def test_shortest_trend_between_two_areas(spark, rows):
    def side(area, *days):
        return spark.createDataFrame(
            [(*area, "temp", "surf", d, v) for d, v in days],
            "waterbody string, station string, parameter string, location string, date date, val double",
        )

    a = side(("A", "1"), (D(2000, 1, 1), 1.0), (D(2012, 1, 1), 2.0), (D(2013, 1, 1), 4.0), (D(2020, 1, 1), 9.0))
    b = side(("B", "2"), (D(2012, 1, 1), 1.0), (D(2013, 6, 1), 3.0))
    crit = spark.createDataFrame([], "waterbody string, station string, WBID string, parameter string, value double")
    pairs = queries.area_pairs(spark, [("A_1", "B_2"), ("A_1", "C_3")])
    out = queries.comparison_series(a, b, crit, "station", "shortest", pairs=pairs)
    got = rows(out.filter("other_waterbody = 'B'"), "date", "trend")
    assert got == [(D(2000, 1, 1), None), (D(2012, 1, 1), pytest.approx(2.0)), (D(2013, 1, 1), pytest.approx(4.0)), (D(2020, 1, 1), None)]
    assert all(t is not None for (t,) in rows(out.filter("other_waterbody = 'C'"), "trend"))  # no rows there: the complete trend
    back = queries.comparison_series(b, a, crit, "station", "shortest", pairs=queries.area_pairs(spark, [("B_2", "A_1")]))
    assert rows(back, "date", "trend") == [(D(2012, 1, 1), pytest.approx(1.0)), (D(2013, 6, 1), pytest.approx(3.0))]
    daily = queries.comparison_series(
        a.withColumn("lovl", a.val), b, crit, "station", "shortest", pairs=queries.area_pairs(spark, [("A_1", "B_2")])
    )
    assert rows(daily, "date", "trend") == got


def test_series_come_in_date_order(spark):
    """All rows of the result, not of a partition: areas one after the other, each by date."""
    days = [D(2020, 1, 1) + dt.timedelta(days=(i * 37) % 90) for i in range(300)]
    rows = [("physical", "c", f"w{i % 3}", str(i % 5), d, "temp", "surf", "f", float(i), None) for i, d in enumerate(days)]
    samples = spark.createDataFrame(
        rows, "type string, county string, waterbody string, station string, date date, parameter string, location string, units string, val double, notes string"
    ).repartition(7)
    areas = [(f"w{i % 3}", str(i % 5), f"R{i % 2}") for i in range(15)]
    stations = spark.createDataFrame(areas, "waterbody string, station string, WBID string")
    criteria = spark.createDataFrame([(*a, "temp", 1.0) for a in areas], "waterbody string, station string, WBID string, parameter string, value double")
    for by, keys in (("station", ("waterbody", "station")), ("region", ("WBID",))):
        got = [tuple(r[c] for c in (*keys, "date")) for r in queries.area_series(samples, stations, criteria, by, "temp", "surf", show_trend="complete").collect()]
        assert got == sorted(got) and len(got) >= 90
    side = queries.comparison_side(samples, stations, "station", "temp_surf")
    got = [(r.waterbody, r.station, r.date) for r in queries.comparison_series(side, side, criteria, "station", "shortest").collect()]
    assert got == sorted(got) and len(got) == 300
    wide = spark.createDataFrame([("w", str(i % 4), dt.datetime(2024, 1, 1) + dt.timedelta(hours=(i * 53) % 400), float(i)) for i in range(400)], "waterbody string, station string, timestamp timestamp, temp_f double").repartition(5)
    for period, at in (("none", "timestamp"), ("day", "date")):
        got = [(r.station, r[at]) for r in queries.sensor_series(wide, "temp", period, show_trend=True).collect()]
        assert got == sorted(got)
