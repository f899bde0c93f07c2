from __future__ import annotations

import datetime as dt

import pytest

from tidemark.operators import choices, criteria, filters, summary
from tidemark.plans import queries
from tidemark.sources import export

D = dt.date
SAMPLES = "type string, county string, waterbody string, station string, date date, parameter string, location string, units string, val double, notes string"


def sample(w, s, day, p, loc, v, notes=None, units="u"):
    return ("physical", "C", w, s, day, p, loc, units, v, notes)


@pytest.fixture(scope="module")
def world(spark):
    st = spark.createDataFrame(
        [("A_x", "1", "n1", "R1", "Bay", -86.0, 30.5), ("A_x", "2", "n2", "R1", "Bay", -86.1, 30.5), ("B", "1", "n3", None, None, -86.2, 30.5), ("C", "1", "n4", "R9", "Lost", -86.2, 30.6)],
        "waterbody string, station string, name string, WBID string, WATERBODY_NAME string, lon double, lat double",
    )
    reg = spark.createDataFrame([("R1", "Bay"), ("R2", "Sea")], "WBID string, WATERBODY_NAME string")
    rows = [
        sample("A_x", "1", D(2020, 1, 1), "temp", "surf", 10.0), sample("A_x", "1", D(2020, 1, 2), "temp", "surf", 20.0),
        sample("A_x", "2", D(2020, 1, 1), "temp", "surf", 60.0), sample("A_x", "1", D(2020, 1, 1), "temp", "bott", 20.0),
        sample("A_x", "1", D(2020, 1, 1), "temp", "surf", None), sample("A_x", "1", D(2020, 1, 1), "temp", "surf", float("nan")),
        sample("B", "1", D(2020, 1, 1), "temp", "surf", 5.0), sample("C", "1", D(2020, 1, 1), "temp", "surf", 6.0),
        sample("Z", "9", D(2020, 1, 1), "temp", "surf", 99.0), sample("A_x", "1", D(2021, 1, 1), "temp", "surf", 99.0),
        sample("A_x", "1", D(2020, 1, 1), "chlcorr", "surf", 3.0),
    ]
    return spark.createDataFrame(rows, SAMPLES), st, reg


def test_region_summary_pools_and_drops_unknown(world, rows):
    s, st, reg = world
    out = summary.area_summary(s, st, reg, "region", "temp", "surf", "2020-01-01", "2020-01-02")
    assert rows(out, "WBID", "val", "n_stations", "stas") == [("R1", 30.0, 2, "2 stations")]


def test_station_summary_keeps_station_without_region(world, rows):
    s, st, reg = world
    out = summary.area_summary(s, st, reg, "station", "temp", "surf", "2020-01-01", "2020-01-02")
    assert rows(out, "stas", "val") == [("A_x_1", 15.0), ("A_x_2", 60.0), ("B_1", 5.0), ("C_1", 6.0)]


def test_blended_locations(world, rows):
    s, st, reg = world
    blend = summary.compare_summary(s, st, reg, "station", "temp_surf", "temp_bott", D(2020, 1, 1), D(2020, 1, 1))
    assert ("A_x_1", 15.0) in rows(blend, "stas", "val")
    apart = summary.compare_summary(s, st, reg, "station", "temp_surf", "temp_bott", D(2020, 1, 1), D(2020, 1, 1), by_location=True)
    assert [r for r in rows(apart, "stas", "location", "val") if r[0] == "A_x_1"] == [("A_x_1", "bott", 20.0), ("A_x_1", "surf", 10.0)]


def test_comparison_with_rain(spark, world, rows):
    s, st, reg = world
    rain = spark.createDataFrame([("G1", "Nice", D(2020, 1, 1), 2.0), ("G1", "Nice", D(2020, 2, 1), 4.0), ("G2", "Far", D(2020, 1, 1), 8.0)], "station string, name string, date date, precip_inches double")
    g = spark.createDataFrame([("G1", "Nice", "R2", "Sea"), ("G2", "Far", None, None)], "station string, name string, WBID string, WATERBODY_NAME string")
    out = summary.compare_summary(s, st, reg, "region", "temp_surf", "rain", "2020-01-01", "2020-12-31", rain, g, reg)
    assert rows(out, "WBID", "parameter", "val", "stas") == [("R1", "temp", 30.0, "2 stations"), ("R2", "rain", 3.0, "1 station")]
    out = summary.compare_summary(s, st, reg, "station", "temp_surf", "rain", "2020-01-01", "2020-12-31", rain, g, reg)
    assert [r for r in rows(out, "stas", "parameter", "val") if r[1] == "rain"] == [("Far_G2", "rain", 8.0), ("Nice_G1", "rain", 3.0)]


def test_two_level_mean(spark, rows):
    st = spark.createDataFrame([("w", "1", "n", "R", "Name", 0.0, 0.0)], "waterbody string, station string, name string, WBID string, WATERBODY_NAME string, lon double, lat double")
    s = spark.createDataFrame([sample("w", "1", D(2020, 1, 1), "temp", "surf", 1.0)] * 3 + [sample("w", "1", D(2020, 1, 2), "temp", "surf", 5.0)], SAMPLES)
    reg = spark.createDataFrame([("R", "Name")], "WBID string, WATERBODY_NAME string")
    assert rows(summary.area_summary(s, st, reg, "region", "temp", "surf"), "val") == [(2.0,)]
    year = queries.comparison_side(s, st, "region", "temp_surf", period="year")
    assert rows(year, "val", "n") == [(3.0, 2)]


def test_criterion_needs_one_value(spark, rows):
    c = spark.createDataFrame(
        [("a", "1", "R1", "tp", 0.1), ("a", "2", "R1", "tp", 0.1), ("b", "1", "R2", "tp", 0.1), ("b", "2", "R2", "tp", 0.2), ("a", "1", "R1", "chl", 4.0)],
        "waterbody string, station string, WBID string, parameter string, value double",
    )
    assert rows(criteria.unique_criteria(c, "region")) == [("R1", "chl", 4.0), ("R1", "tp", 0.1)]
    df = spark.createDataFrame([("R1", "chlcorr"), ("R1", "chluncorr"), ("R2", "tp"), (None, "tp")], "WBID string, parameter string")
    got = rows(criteria.with_criterion(df, c, "region"), "WBID", "parameter", "criterion")
    assert got == [(None, "tp", None), ("R1", "chlcorr", 4.0), ("R1", "chluncorr", 4.0), ("R2", "tp", None)]


def test_gauge(spark, world, rows):
    s, st, reg = world
    c = spark.createDataFrame([("A_x", "1", "R1", "chl", 4.0)], "waterbody string, station string, WBID string, parameter string, value double")
    g = queries.area_gauge(s, st, reg, c, "region", "chlcorr", "surf")
    assert rows(g, "shown", "scale_min", "scale_max", "criterion", "unit") == [(3.0, 0.0, 4.0, 4.0, "ug/L")]
    g = queries.area_gauge(s, st, reg, c, "region", "temp", "surf", "2020-01-01", "2020-01-02")
    assert rows(g, "shown", "shown_celsius", "scale_max", "unit") == [(30.0, -1.11, 30.0, "F / C")]


def test_catalogue_overview_span(world, rows):
    s, st, _ = world
    cat = summary.catalogue(s)
    assert rows(cat, "parameter", "location", "label", "datestr", "dateend") == [
        ("chlcorr", "surf", "Chl-a Corrected (ug/L)", D(2020, 1, 1), D(2020, 1, 1)),
        ("temp", "bott", "Temperature (F)", D(2020, 1, 1), D(2020, 1, 1)),
        ("temp", "surf", "Temperature (F)", D(2020, 1, 1), D(2021, 1, 1)),
    ]
    assert rows(summary.overview(s, st)) == [("11", 2, 4, 4, "2020 to 2021")]
    assert ("B", "1", D(2020, 1, 1), D(2020, 1, 1)) in rows(summary.with_span(st, s), "waterbody", "station", "datestr", "dateend")


def test_choices(spark, world):
    s, _, _ = world
    cat = summary.catalogue(s)
    rain = spark.createDataFrame([("G1", "Nice", D(2020, 1, 1), 2.0)], "station string, name string, date date, precip_inches double")
    got = [tuple(r) for r in choices.parameter_choices(s, rain, cat, "2020-01-01", "2020-12-31").collect()]
    assert got == [("rain", "Rainfall"), ("chlcorr_surf", "Chl-a Corrected"), ("temp_bott", "Temperature: Bottom"), ("temp_surf", "Temperature: Surface")]
    assert "rain" not in [r[0] for r in choices.parameter_choices(s, rain, cat, "2021-01-01", "2021-12-31").collect()]
    assert [tuple(r)[:2] for r in choices.location_choices(cat).collect()] == [("chlcorr", "Surface"), ("temp", "Surface"), ("temp", "Bottom")]
    assert [r[0] for r in choices.waterbody_list(s).collect()] == ["A_x", "B", "C", "Z"]
    assert [r[0] for r in choices.date_choices(s, parameter=["chlcorr"]).collect()] == [D(2020, 1, 1)]
    assert choices.date_choices(s, parameter=["nothing"]).count() == 0
    labels = {(r[0], r[1]): r[2] for r in choices.axis_labels_with_rain(cat).collect()}
    assert labels[("temp", "surf")] == "Mean Temperature (F): Surface" and labels[("chlcorr", "surf")] == "Mean Chl-a Corrected (ug/L)"
    assert labels[("rain", "rain")] == "Cumulative rainfall (inches)"


def test_english_order(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in ("pH", "Depth", "color", "Salinity", "Chl-a")], "label string")
    assert [r[0] for r in df.orderBy(F.expr("label COLLATE en")).collect()] == ["Chl-a", "color", "Depth", "pH", "Salinity"]


def test_export(world, tmp_path, spark):
    s, _, _ = world
    out = filters.export_filter(s, ["A_x"], ["temp"], "2020-01-02", "2020-12-31")
    assert "type" not in out.columns
    path = str(tmp_path / "out")
    export.write_export(out, path)
    lines = [r[0] for r in spark.read.text(path).collect()]
    header = '"county","waterbody","station","date","parameter","location","units","val","notes"'
    # every part file starts with the header
    assert [x for x in lines if x != header] == ['"C","A_x","1",2020-01-02,"temp","surf","u",20,NA'] and header in lines
    many = spark.createDataFrame([("A_x",), ("B",)], "waterbody string")
    assert filters.export_filter(s, many, ["temp"], "2020-01-01", "2020-01-01").count() == 6


def test_export_quotes_inside_text(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', 1.5, None)], "a string, b double, c string")
    path = str(tmp_path / "out")
    export.write_export(df, path)
    assert {r[0] for r in spark.read.text(path).collect()} == {'"a","b","c"', '"say ""hi"", you",1.5,NA'}
    # and it reads back as CSV
    back = spark.read.option("header", True).option("escape", '"').option("nullValue", "NA").csv(path)
    assert tuple(back.first()) == ('say "hi", you', "1.5", None)


def test_guards(world):
    s, _, _ = world
    assert filters.nothing(s).count() == 0
    assert s.filter(filters.pair_filter("temp_bott", "chlcorr_surf")).count() == 2
