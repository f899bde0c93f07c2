from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, rain
from tidemark.plans import build
from tidemark.sources import polygons, rain_payloads, sheets, tables, versions

D = dt.date


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def feature(wbid, name, ring, kind="Polygon"):
    coords = [ring] if kind == "Polygon" else [[ring], [[[90, 1], [91, 1], [91, 2], [90, 1]]]]
    return {"type": "Feature", "properties": {"WBID": wbid, "WATERBODY_NAME": name, "extra": 1}, "geometry": {"type": kind, "coordinates": coords}}


@pytest.fixture
def sources(tmp_path):
    s = {}
    s["field"] = write(tmp_path / "field.csv", "\n".join([
        "County,Water Body,Station Number,Date (Month/Day/Year),Month,Day,Year,Time (24hr),Temperature Surface (F),Temperature Bottom (F),Dissolved Oxygen Surface (mg/L)",
        "okaloosa,Swift creek-1,1,3/4/2021,3,4,2021,0900,70.5,.,NA",
        "Walton,Deer,2,3/5/2021,3,5,2021,0900,60,50,7.5",
    ]))
    s["lab"] = write(tmp_path / "lab.csv", "\n".join([
        "County,Lake,Date,Month,Day,Year,Station,TP (µg/L),TN (µg/L),CHL (µg/L) uncorrected,CHL (µg/L) corrected,Secchi (ft),Secchi 2,Color (Pt-Co units),Cond (µS/cm),Cond (mS/cm),1",
        "Bay,Deer,3/4/2021,3,4,2021,2,12broken,300,4,3,.,Bottom (3.5),10,250,NA,",
        "Bay,Gone,3/4/2021,3,4,2021,1,12,300,4,3,.,,10,250,NA,",
    ]))
    s["exclusions"] = write(tmp_path / "gone.csv", "waterbody,station\nGone,1\n")
    s["stations"] = write(tmp_path / "stations.csv", "\n".join([
        "CBA Waterbody Name,CBA Station #,Monitoring Location Name,WBID,GPS abbr.,Latitude,Longitude",
        "Swift Creek-1,1,Swift one,10,x,-86.5,30.5",
        "Deer,2,Deer two,20,y,-86.0,30.5",
        "Far,1,Far one,30,z,-10.0,10.0",
    ]))
    docs = {"type": "FeatureCollection", "features": [
        feature("10", "SWIFT CREEK (lower)", [[-86.6, 30.4], [-86.4, 30.4], [-86.4, 30.6], [-86.6, 30.6]]),
        feature("20", "DEER LAKE", [[-86.1, 30.4], [-85.9, 30.4], [-85.9, 30.6], [-86.1, 30.6], [-86.1, 30.4]], "MultiPolygon"),
        feature("21", "BIG REGION", [[-86.2, 30.3], [-85.8, 30.3], [-85.8, 30.7], [-86.2, 30.7], [-86.2, 30.3]]),
        feature("644", "GAUGE POND", [[-86.55, 30.7], [-86.5, 30.7], [-86.5, 30.8], [-86.55, 30.8], [-86.55, 30.7]]),
        feature("99", "LINE", [[0, 0], [1, 1]]),
    ]}
    s["polygons"] = write(tmp_path / "regions.geojson", json.dumps(docs, indent=1))
    rain_dir = tmp_path / "rain"
    rain_dir.mkdir()
    for i, (st, days) in enumerate([("USW00013884", [("2020-05-01", 0.1), ("2020-05-31", 0.2), ("2020-06-01", 0.4)]), ("USC00099999", [("2020-05-01", 1.0)])]):
        write(rain_dir / f"{i}.json", json.dumps({"metadata": {"n": 1}, "results": [
            {"date": f"{d}T00:00:00", "datatype": "PRCP", "station": f"GHCND:{st}", "attributes": ",,", "value": v} for d, v in days]}))
    write(rain_dir / "empty.json", "{}")
    s["rain"] = str(rain_dir)
    s["criteria"] = write(tmp_path / "criteria.csv", "\n".join([
        "CBA Waterbody Name,CBA Station #,Name,WBID,Total Phosphorus (mg/L),Total Nitrogen (mg/L),Chlorophyll a (μg/L)",
        "Swift Creek-1,1,x,46,0.05,NA,.",
        "Deer,2,y,20,0.06,1.1,20",
    ]))
    return s


def test_build_all(spark, sources, tmp_path, rows):
    folder = str(tmp_path / "tables")
    build.build_all(spark, sources, folder)
    t = {n: tables.load_table(spark, folder, n) for n in ("samples", "stations", "regions", "rain", "gauges", "rain_regions", "catalogue", "criteria")}
    got = rows(t["samples"], "type", "waterbody", "parameter", "location", "units", "val", "notes")
    assert ("physical", "Swift Creek-1", "temp", "surf", "f", 70.5, None) in got
    assert ("discrete", "Deer", "secchi", "surf", "ft", 3.5, "on bottom") in got
    assert ("discrete", "Deer", "tp", "surf", "mgl", 0.012, None) in got
    assert ("discrete", "Deer", "chluncorr", "surf", "ugl", 4.0, None) in got
    assert ("discrete", "Deer", "cond", "surf", "mscm", 0.25, None) in got
    assert not any(r[1] == "Gone" for r in got) and len(got) == 11
    assert rows(t["stations"], "waterbody", "station", "WBID", "WATERBODY_NAME", "datestr", "lon") == [
        ("Deer", "2", "20", "Deer Lake", D(2021, 3, 4), -86.0),
        ("Far", "1", None, None, None, -10.0),
        ("Swift Creek-1", "1", "10", "Swift Creek (Lower)", D(2021, 3, 4), -86.5),
    ]
    assert rows(t["rain_regions"], "WBID") == [("10",), ("644",)]
    assert rows(t["regions"], "WBID") == [("10",), ("20",), ("21",)]
    assert rows(t["rain"]) == [("USC00099999", None, D(2020, 5, 1), 1.0), ("USW00013884", "Crestview", D(2020, 5, 1), pytest.approx(0.3)), ("USW00013884", "Crestview", D(2020, 6, 1), 0.4)]
    assert rows(t["gauges"], "name", "WBID") == [("Crestview", "644"), ("Geneva", None), ("Niceville", "10")]
    assert rows(t["criteria"], "WBID", "parameter", "value") == [("20", "chl", 20.0), ("20", "tn", 1.1), ("20", "tp", 0.06), ("49F", "tp", 0.05)]
    assert ("do", "Dissolved Oxygen (mg/L)") in rows(t["catalogue"], "parameter", "label")
    assert checks.unknown_physical_stations(t["samples"], t["stations"]).count() == 0
    # the parameter is a partition: a query on one parameter lists only its folder
    plan = t["samples"].filter("parameter = 'temp'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(parameter" in plan
    tables.save_table(spark.createDataFrame(t["rain"].collect(), t["rain"].schema), folder, "rain")
    assert tables.load_table(spark, folder, "rain").count() == 3  # overwritten, not appended


def test_missing_column_is_an_error(spark, tmp_path):
    p = write(tmp_path / "x.csv", "waterbody\na\n")
    with pytest.raises(ValueError, match="station"):
        sheets.read_exclusions(spark, p)


def test_rings_are_closed_and_degenerate_ones_dropped(spark, sources, rows):
    df = polygons.read_geojson(spark, sources["polygons"])
    sizes = dict(rows(df.select("WBID", F.transform("rings", lambda r: F.size(r)).alias("s"))))
    assert sizes == {"10": [5], "20": [5, 4], "21": [5], "644": [5]}
    assert rows(df.filter("WBID = '10'"), "xmin", "ymin", "xmax", "ymax") == [(-86.6, 30.4, -86.4, 30.6)]


def test_geojson_by_lines_and_what_is_no_polygon(spark, tmp_path, rows):
    def line(shape, coordinates):
        return json.dumps({"type": "Feature", "properties": {"WBID": "1", "WATERBODY_NAME": "A"}, "geometry": {"type": shape, "coordinates": coordinates}})

    ring = [[0, 0], [1, 0], [0, 1]]
    good = write(tmp_path / "good.jsonl", "\n".join([line("Polygon", [ring]), line("MultiPolygon", [[ring], [ring]])]))
    df = polygons.read_geojson(spark, good, lines=True)
    assert rows(df.select(F.transform("rings", lambda r: F.size(r)).alias("s"))) == [([4, 4],), ([4],)]
    for name, bad in (("line", line("LineString", ring)), ("text", line("Polygon", "x")), ("cut", line("Polygon", [ring])[:-9])):
        path = write(tmp_path / f"{name}.jsonl", bad)
        with pytest.raises(Exception):
            polygons.read_geojson(spark, path, lines=True).collect()


def test_rain_payloads(spark, sources, rows):
    daily = rain_payloads.read_rain_payloads(spark, sources["rain"])
    assert daily.count() == 4
    assert rows(rain.rain_monthly(daily), "station", "date", "precip_inches")[1] == ("USW00013884", D(2020, 5, 1), pytest.approx(0.3))


def test_box_plot(spark):
    vals = [float(v) for v in (1, 2, 3, 4, 5, 6, 7, 100)]
    df = spark.createDataFrame([("g", D(2020, 1, 1), v) for v in vals + [0.0]], "station string, date date, precip_inches double")
    r = rain.rain_distribution(df).first()
    assert (r["n"], r["q25"], r["median"], r["q75"], r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (8, 2.75, 4.5, 6.25, 1.0, 7.0, 1)
    assert [x["precip_inches"] for x in rain.rain_outliers(df).collect()] == [100.0]


def test_sheets_of_many_files_in_two_orders(spark, tmp_path, rows):
    a, b = "a,b,c", "c,a,b"
    for i in range(60):
        body = f'{i},"x, ""{i}""",\n\n' if i % 2 else f',{i},"x, ""{i}"""\n.,NA,z{i}\n'
        (tmp_path / f"f{i}.csv").write_text(f"{a if i % 2 else b}\n{body}")
    df = sheets.read_text_sheet(spark, str(tmp_path), ("a", "c"))
    assert rows(df, "a", "b", "c") == sorted(
        [(str(i), f'x, "{i}"', None) for i in range(60)] + [(None, f"z{i}", None) for i in range(0, 60, 2)], key=lambda t: tuple((v is not None, str(v)) for v in t)
    )
    plan = lambda d: len(d._jdf.queryExecution().analyzed().toString().splitlines())
    before = plan(df)
    for i in range(60, 120):
        (tmp_path / f"f{i}.csv").write_text(f"{a}\n1,2,3\n")
    more = sheets.read_text_sheet(spark, str(tmp_path))
    assert plan(more) == before and more.count() == df.count() + 60
    (tmp_path / "wide.csv").write_text(f"{a}\n1,2,3,4\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        sheets.read_text_sheet(spark, str(tmp_path)).collect()
    (tmp_path / "wide.csv").write_text("a,b,d\n1,2,3\n")
    with pytest.raises(ValueError, match="different headings"):
        sheets.read_text_sheet(spark, str(tmp_path))


def test_sheets_need_their_headings(spark, tmp_path):
    (tmp_path / "f.csv").write_text("County,Water Body,Station Number\nBay,Deer,1\n")
    for read in (sheets.read_field_sheet, sheets.read_lab_sheet):
        with pytest.raises(ValueError, match="missing columns"):
            read(spark, str(tmp_path / "f.csv"))


def test_a_failed_build_leaves_the_version_before(spark, sources, tmp_path, rows):
    folder, names = str(tmp_path / "model"), ("samples", "stations", "rain")
    show = lambda t: {n: rows(t[n]) for n in names}
    with pytest.raises(FileNotFoundError):
        versions.current(spark, folder)
    build.build_version(spark, sources, folder)
    first = versions.current(spark, folder)
    reader = tables.load_tables(spark, first, names)
    before = show(reader)
    with pytest.raises(Exception, match="(?i)station"):  # tables before the station list are written by then
        build.build_version(spark, {**sources, "stations": sources["lab"]}, folder)
    assert versions.current(spark, folder) == first and show(tables.load_tables(spark, versions.current(spark, folder), names)) == before
    with open(sources["exclusions"], "a") as f:
        f.write("Deer,2\n")
    build.build_version(spark, sources, folder)
    second = versions.current(spark, folder)
    after = show(tables.load_tables(spark, second, names))
    assert second != first and after["rain"] == before["rain"] and len(after["samples"]) < len(before["samples"])
    assert show(reader) == before  # a reader across a rebuild stays with its version
    build.build_version(spark, sources, folder)
    assert sorted(p.name for p in (tmp_path / "model" / "versions").iterdir()) == [second.rsplit("/", 1)[1], versions.current(spark, folder).rsplit("/", 1)[1]]


def test_checks_of_rows_ride_on_the_build(spark, sources, tmp_path):
    found = {}
    build.build_all(spark, sources, str(tmp_path / "tables"), found=found)
    t = tables.load_tables(spark, str(tmp_path / "tables"), ("samples", "rain"))
    bad = {"sample dates": checks.sample_dates_outside(t["samples"]).agg(F.sum("n")).first()[0] or 0, "sample locations": 0,
           "rain values": checks.negative_rain(t["rain"]).count(), "rain dates": checks.rain_dates_outside(t["rain"]).agg(F.sum("n")).first()[0] or 0}
    assert found == bad
    rows = spark.createDataFrame([(D(1980, 1, 1), "surf", 1.0), (None, "deep", 2.0), (D(2020, 1, 1), None, -1.0), (D(2020, 1, 1), "bott", float("nan"))], "date date, location string, precip_inches double")
    got = rows.agg(*[c.alias(n) for m in checks.row_metrics().values() for n, c in m.items()]).first().asDict()
    assert got == {"sample dates": 2, "sample locations": 2, "rain values": 2, "rain dates": 2}
