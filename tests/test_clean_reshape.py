from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import clean, joins, reshape

D = dt.date


def field(spark):
    cols = ["County", "Water Body", "Station Number", "Date (Month/Day/Year)", "Month", "Day", "Year", "Time (24hr)", "Temperature Surface (F)", "pH Surface", "Depth Bottom (ft)"]
    rows = [("okaloosa", "Swift creek-1", "1", "3/4/2021", "3", "4", "2021", "0900", "70.5", "7.1", None), ("Bay", "Deer", "2", "3/5/2021", "3", "5", "2021", "0900", "bad", None, "4")]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def lab(spark, rows):
    cols = ["County", "Lake", "Date", "Month", "Day", "Year", "Station", "TP (µg/L)", "TN (µg/L)", "Secchi (ft)", "Secchi 2", "Cond (µS/cm)", "Cond (mS/cm)", "1"]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


LAB = [
    ("Bay", "CBA GAP-1", "3/4/2021", "3", "4", "2021", "1", "12broken", "_300", None, "Bottom (3.5)", "250", None, None),
    ("Bay", "CBA GAP-1", "3/4/2021", "3", "4", "2021", "1", "12", "300", None, "Bottom (3.5)", "250", "0.3", None),
    ("Bay", "Deer", "3/4/2021", "3", "4", "2021", "2", "Not Reported", "1", "2", "Weeds", None, None, None),
    ("Bay", "Gone", "3/4/2021", "3", "4", "2021", None, "5", "5", "5", None, None, None, None),
]


def test_field_sheet(spark, rows):
    c = clean.clean_field_sheet(field(spark))
    assert c.columns == ["county", "waterbody", "station", "date", "temp_surf_f", "ph_surf_su", "depth_bott_ft"]
    assert rows(c) == [
        ("Bay", "Deer", "2", D(2021, 3, 5), None, None, 4.0),
        ("Okaloosa", "Swift Creek-1", "1", D(2021, 3, 4), 70.5, 7.1, None),
    ]
    long = reshape.field_long(c)
    assert long.count() == 6  # missing values keep their row
    assert ("temp", "surf", "f", 70.5) in rows(long, "parameter", "location", "units", "val")


def test_lab_sheet(spark, rows):
    gone = spark.createDataFrame([("Gone", None)], "waterbody string, station string")
    c = clean.clean_lab_sheet(lab(spark, LAB), gone)
    assert "x1" not in c.columns and c.columns[:4] == ["county", "waterbody", "station", "date"]
    got = rows(c, "waterbody", "station", "tp_mgl", "tn_mgl", "secchi_ft", "secchi_onbott", "cond_mscm")
    assert got == sorted([("CBA Gap-1", "1", 0.012, 0.3, 3.5, True, 0.25), ("CBA Gap-1", "1", 0.012, 0.3, 3.5, True, 0.3), ("Deer", "2", None, 0.001, 2.0, True, None)], key=str)


def test_lab_long_equals_notes_look_up(spark, rows):
    """Carrying the note along gives what the look-up by six keys gives."""
    extra = [("Bay", "Deer", "3/4/2021", "3", "4", "2021", "2", None, None, "2", None, None, None, None)]
    c = clean.clean_lab_sheet(lab(spark, LAB + extra))
    fast = reshape.lab_long(c)
    long = reshape.split_variable(reshape.to_long(c.drop("secchi_onbott")), ("parameter", "units")).withColumn("location", F.lit("surf"))
    slow = joins.attach_notes(long, reshape.secchi_notes(c), ["county", "waterbody", "station", "date", "parameter", "val"])
    cols = ("county", "waterbody", "station", "date", "parameter", "units", "location", "val", "notes")
    valid = "val IS NOT NULL"
    assert rows(fast.filter(valid), *cols) == rows(slow.filter(valid), *cols)
    # one depth with and without note fans out
    assert sorted(str(n) for *_, n in rows(fast.filter("parameter = 'secchi' AND waterbody = 'Deer'"), *cols)) == ["None", "on bottom"]


def test_split_variable_short_and_long(spark, rows):
    df = spark.createDataFrame([("a_b_c_d", 1.0), ("a_b", 2.0)], "var string, val double")
    assert rows(reshape.split_variable(df, ("p", "l", "u")), "p", "l", "u") == [("a", "b", None), ("a", "b", "c")]


def test_tidy_union_and_valid(spark, rows):
    a = spark.createDataFrame([("C", "w", "1", D(2020, 1, 1), "temp", "surf", "f", 1.0, None), ("C", "w", "1", D(2020, 1, 1), "temp", "surf", "f", float("nan"), None)],
                              "county string, waterbody string, station string, date date, parameter string, location string, units string, val double, notes string")
    b = a.drop("notes").filter("val = 1.0")
    out = reshape.tidy_samples(physical=a, discrete=b)
    assert rows(out, "type", "val", "notes") == [("discrete", 1.0, None), ("physical", 1.0, None)]


def test_criteria(spark, rows):
    wide = spark.createDataFrame([("w", "1", "46", 0.1, None, 3.0)], "waterbody string, station string, WBID string, tp double, tn double, chl double")
    assert rows(reshape.criteria_long(clean.clean_criteria(wide)), "WBID", "parameter", "value") == [("49F", "chl", 3.0), ("49F", "tp", 0.1)]


def test_exclude_null_key(spark, rows):
    a = spark.createDataFrame([("a", None), ("a", "1")], "waterbody string, station string")
    assert rows(joins.exclude(a, a.filter("station IS NULL"))) == [("a", "1")]


def test_station_grid_and_pivot(spark, rows):
    st = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], "waterbody string, station string")
    grid = joins.station_grid(st, ("t", "s"))
    assert grid.count() == 4
    wide = reshape.to_wide(grid.withColumn("v", F.lit(2.0)), ["waterbody", "station"], "type", "v", ["t", "s", "none"])
    assert rows(wide) == [("a", "1", 2.0, 2.0, None), ("b", "1", 2.0, 2.0, None)]


def test_long_form_splits_names_once(spark, rows):
    wide = spark.createDataFrame([("c", "w", "s", D(2020, 1, 2), 1.0, None, 2.0)], "county string, waterbody string, station string, date date, temp_surf_f double, ph_bott double, a_b_c_d double")
    ids = ["county", "waterbody", "station", "date"]
    got = reshape.to_named_parts(wide, ("parameter", "location", "units"))
    want = reshape.split_variable(reshape.to_long(wide), ("parameter", "location", "units"))
    assert got.columns == want.columns == [*ids, "val", "parameter", "location", "units"] and rows(got) == rows(want)
    assert "split(" in want._jdf.queryExecution().toString() and "split(" not in reshape.field_long(wide)._jdf.queryExecution().toString()
