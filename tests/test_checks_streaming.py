from __future__ import annotations

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import checks, continuous, moments, rain, trend
from tidemark.streaming import jobs, snapshots

D = dt.date


def test_set_checks(spark, rows):
    s = spark.createDataFrame([("Bay",), ("Holmes",), ("Leon",), (None,)], "county string")
    assert rows(checks.county_mismatch(s)) == [("Leon", "unexpected"), ("Okaloosa", "missing"), ("Walton", "missing"), ("Washington", "missing")]
    good = spark.createDataFrame([(w,) for w in S.WATERBODIES], "waterbody string")
    assert checks.waterbody_mismatch(good).count() == 0 and len(set(S.WATERBODIES)) == 102 and len(set(S.REGION_IDS)) == 48


def test_region_checks(spark, rows):
    st = spark.createDataFrame([("570",), ("49",), ("XX",), (None,)], "WBID string")
    reg = spark.createDataFrame([("570",), ("XX",)], "WBID string")
    assert rows(checks.station_region_problems(st, reg)) == [("1", "without region"), ("49", "unknown"), ("XX", "unexpected")]
    g = spark.createDataFrame([("644",), ("160B",), (None,)], "WBID string")
    assert checks.gauge_region_problems(g, g.filter("WBID IS NOT NULL")).count() == 0


def test_value_checks(spark, rows):
    df = spark.createDataFrame([(D(1990, 1, 1), 0.0), (D(2020, 1, 1), -1.0), (D(2999, 1, 1), None), (D(1989, 12, 31), float("nan"))], "date date, precip_inches double")
    assert rows(checks.rain_dates_outside(df), "date") == [(D(1989, 12, 31),), (D(2999, 1, 1),)]
    assert checks.negative_rain(df).count() == 3
    loc = spark.createDataFrame([("surf",), ("bott",), ("mid",), (None,)], "location string")
    assert rows(checks.bad_locations(loc)) == [(None, 1), ("mid", 1)]
    audit = checks.audit({"rain": checks.negative_rain(df), "fine": df.limit(0)})
    assert rows(audit) == [("fine", 0, True), ("rain", 3, False)]


def test_null_region_in_criteria_is_reported(spark, rows):
    c = spark.createDataFrame([("R1",), (None,)], "WBID string")
    assert rows(checks.criteria_unknown_regions(c, c.filter("WBID = 'R1'"))) == [(None,)]


def test_backward_steps_all_stations(spark, rows):
    t = dt.datetime(2024, 1, 1)
    data = []
    for st in "abc":
        for i in range(30):
            back = st == "c" and i in (10, 20)
            data.append(("w", st, i, t + dt.timedelta(minutes=15 * (i - (2 if back else 0)))))
    df = spark.createDataFrame(data, "waterbody string, station string, seq int, timestamp timestamp")
    bad = checks.backward_steps(df, "seq", F.floor(F.col("seq") / 10))
    assert rows(bad, "station", "seq") == [("c", 10), ("c", 20)]


def wide(n=400, seed=2):
    rnd = random.Random(seed)
    t = dt.datetime(2024, 1, 1)
    return [("w", str(rnd.randrange(3)), t + dt.timedelta(minutes=3 * i), i, rnd.gauss(70, 5), rnd.gauss(20, 2) if i % 7 else None) for i in range(n)]


WIDE = "waterbody string, station string, timestamp timestamp, seq int, temp_f double, sal_ppt double"


@pytest.fixture
def feed(spark, tmp_path):
    """Four files, in order of arrival; the first rows of each repeat the last of the one before."""
    data = wide()
    src = tmp_path / "feed"
    for i in range(4):
        part = data[max(0, 100 * i - 5) : 100 * (i + 1)]
        spark.createDataFrame(part, WIDE).coalesce(1).write.mode("append").parquet(str(src))
    return str(src), spark.createDataFrame(data, WIDE), tmp_path


def test_stream_equals_batch(spark, feed, rows):
    src, batch, tmp = feed
    stream = jobs.read_feed(spark, src, batch.schema, files_per_batch=1)
    clean = jobs.deduplicated(jobs.sensor_readings(stream), "2 hours")
    jobs.append_to(clean, f"{tmp}/rows", f"{tmp}/c1").awaitTermination()
    got = spark.read.parquet(f"{tmp}/rows")
    long = continuous.continuous_long(batch.drop("seq")).filter("val IS NOT NULL")
    cols = ("waterbody", "station", "timestamp", "variable", "val")
    assert rows(got, *cols) == rows(long, *cols)

    means = jobs.window_means(jobs.deduplicated(jobs.sensor_readings(stream), "2 hours"), "1 hour")
    jobs.update_to(means, f"{tmp}/means", f"{tmp}/c2").awaitTermination()
    newest = jobs.latest(spark, f"{tmp}/means", ["start", *jobs.SERIES])
    want = jobs.window_means(long, "1 hour")
    key = lambda df: {(r["start"], r["station"], r["variable"]): (r["n"], r["val"], r["lovl"]) for r in df.collect()}
    a, b = key(newest), key(want)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1]) and (a[k][2] is None) == (b[k][2] is None)


def test_stream_enriched_and_unknown(spark, feed, rows):
    src, batch, tmp = feed
    st = spark.createDataFrame([("w", "0", "R"), ("w", "1", "R")], "waterbody string, station string, WBID string")
    crit = spark.createDataFrame([("w", "0", "R", "tem", 70.0)], "waterbody string, station string, WBID string, parameter string, value double")
    stream = jobs.sensor_readings(jobs.read_feed(spark, src, batch.schema, 1), ("temp_f",))
    out = jobs.enriched(jobs.window_means(stream.withWatermark("timestamp", "2 hours"), "1 hour"), st, crit)
    jobs.update_to(out, f"{tmp}/rich", f"{tmp}/c3").awaitTermination()
    got = jobs.latest(spark, f"{tmp}/rich", ["start", *jobs.SERIES])
    assert {r["station"] for r in got.collect()} == {"0", "1"}
    for r in got.collect():
        assert r["above"] == (r["val"] > 70.0) if r["station"] == "0" else r["above"] is None
    lost = jobs.unknown_stations(jobs.sensor_readings(jobs.read_feed(spark, src, batch.schema), ("temp_f",)), st)
    jobs.append_to(lost, f"{tmp}/lost", f"{tmp}/c4").awaitTermination()
    assert {r["station"] for r in spark.read.parquet(f"{tmp}/lost").collect()} == {"2"}


def test_steps_across_batches(spark, tmp_path, rows):
    t = dt.datetime(2024, 1, 1)
    first = [("w", "a", i, t + dt.timedelta(minutes=i)) for i in range(5)]
    second = [("w", "a", 5 + i, t + dt.timedelta(minutes=3 + i)) for i in range(4)]  # steps back once, at the border
    third = [("w", "b", 0, t)]
    ddl = "waterbody string, station string, seq int, timestamp timestamp"
    src = str(tmp_path / "src")
    for part in (first, second, third):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(src)
    stream = jobs.read_feed(spark, src, spark.createDataFrame(first, ddl).schema, 1)
    jobs.check_steps(stream, "seq", str(tmp_path / "out"), str(tmp_path / "cp"), 2).awaitTermination()
    assert rows(jobs.step_violations(spark, str(tmp_path / "out")), "station", "seq") == [("a", 5)]


RAIN = "station string, name string, date date, precip_inches double"


def test_rain_months_rewrite_touched_months_only(spark, tmp_path, rows):
    nan = float("nan")
    parts = [
        [("G", "g", D(2020, 5, 1), 0.1), ("G", "g", D(2020, 7, 1), None), ("H", None, D(2020, 4, 1), nan), (None, "x", None, 1.0)],
        [("G", "g", D(2020, 6, 1), 0.4), ("G", "g", D(2020, 5, 2), 0.2), ("G", "g", D(2020, 5, 3), nan)],
        [("G", "g", D(2020, 5, 9), 0.5)],
    ]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    stamp = lambda: {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in sorted((tmp_path / "out" / "months").glob("month=*/part*"))}
    before = {}
    for i, p in enumerate(parts):
        spark.createDataFrame(p, RAIN).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.read_feed(spark, src, spark.createDataFrame(p, RAIN).schema)
        jobs.rain_months_to(stream, out, f"{tmp_path}/cp").awaitTermination()
        now, touched = stamp(), {f"month={r[2]:%Y-%m}" if r[2] else "month=none" for r in p}
        assert {m for m in now if now[m] != before.get(m)} == touched
        before = now
        want = rain.monthly_totals(spark.createDataFrame([r for q in parts[: i + 1] for r in q], RAIN))
        assert [(r[:3], round(r[3], 9)) for r in rows(jobs.rain_months(spark, out))] == [(r[:3], round(r[3], 9)) for r in rows(want)]


def test_rain_months_replayed_batch(spark, tmp_path, rows):
    """The last batch runs again where its commit was lost."""
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for p in ([("G", "g", D(2020, 5, 1), 0.1)], [("G", "g", D(2020, 5, 2), 0.2), ("G", "g", D(2020, 6, 1), 0.4)]):
        spark.createDataFrame(p, RAIN).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.read_feed(spark, src, spark.createDataFrame(p, RAIN).schema)
        jobs.rain_months_to(stream, out, cp).awaitTermination()
    once = rows(jobs.rain_months(spark, out))
    for f in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / f).unlink()
    jobs.rain_months_to(stream, out, cp).awaitTermination()
    assert rows(jobs.rain_months(spark, out)) == once and len(once) == 2


def arrivals(spark, tmp_path, parts, ddl, run):
    """Each part arrives, then the job runs till it is used up: one batch a part, from the checkpoint of the one before."""
    for p in parts:
        spark.createDataFrame(p, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        run(jobs.read_feed(spark, str(tmp_path / "src"), spark.createDataFrame(p, ddl).schema))


READING = "waterbody string, station string, variable string, timestamp timestamp, val double"


def test_sorted_out_keeps_late_and_repeated_rows(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    row = lambda s, m: ("w", s, "temp_f", t(m), float(m))
    parts = [
        [row("a", 0), row("a", 10), row("a", 10), row(None, 5)],
        [row("a", 10), row("a", 120), row("b", 100), row(None, 5)],
        [row("a", 10), row("a", 59), row("a", 60), row("b", 100), row("a", 120)],
        [row("a", 61)],
    ]
    run = lambda stream: jobs.sorted_out_to(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    arrivals(spark, tmp_path, parts, READING, run)
    got = [(r.kind, r.station, int(r.val)) for r in jobs.sorted_out(spark, f"{tmp_path}/out").collect()]
    key = lambda x: (x[0], x[1] or "", x[2])
    assert sorted(got, key=key) == sorted([
        ("kept", "a", 0), ("kept", "a", 10), ("repeated", "a", 10), ("kept", None, 5), ("repeated", "a", 10), ("kept", "a", 120), ("kept", "b", 100),
        ("repeated", None, 5), ("late", "a", 10), ("late", "a", 59), ("kept", "a", 60), ("repeated", "b", 100), ("repeated", "a", 120), ("kept", "a", 61),
    ], key=key)
    assert len(got) == sum(map(len, parts)) and len(list((tmp_path / "out" / "seen").glob("batch=*"))) <= 2


def test_gaps_and_late_readings(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    row = lambda s, m: ("w", s, "temp_f", t(m), 0.0)
    minutes = {"a": [0, 30, 200, 230, 600, 1200], "b": list(range(0, 1200, 20)), "c": [0, 300, 325, 900, 1190]}
    every = sorted((m, s) for s, at in minutes.items() for m in at)
    late = {("a", 230): 40, ("c", 300): 30, ("c", 325): 50}
    arrival = lambda m, s: m + late.get((s, m), 0)
    parts = [[row(s, m) for m, s in every if lo <= arrival(m, s) < hi] for lo, hi in ((0, 250), (250, 330), (330, 1000), (1000, 9999))]
    run = lambda stream: jobs.append_to(jobs.stretches(stream.withWatermark("timestamp", "1 hour"), "2 hours"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    arrivals(spark, tmp_path, parts, READING, run)
    got = {(r.station, r.gap_start, r.gap_end, r.seconds) for r in jobs.gaps(spark.read.parquet(f"{tmp_path}/out")).collect()}
    closed = {(s, a, b) for s, at in minutes.items() for a, b in zip(at, at[1:]) if b - a > 120}
    # a stretch is finished once the watermark, an hour behind the newest reading, has passed it by the silence
    upto = 1200 - 60 - 120
    last_of = lambda s, b: max(m for m in minutes[s] if not any(x[0] == s and b <= x[1] < m for x in closed) and m >= b)
    assert got == {(s, t(a), t(b), (b - a) * 60.0) for s, a, b in closed if last_of(s, b) <= upto} and len(got) == 4


def test_late_within_the_tolerance_is_no_backward_step(spark, tmp_path, rows):
    t = dt.datetime(2024, 1, 1)
    at = [0, 15, 30, 45, 20, 50, 60, 55, 120, 40, 45, 130]  # 20 and 55 are late by less than an hour, 40 is not; 45 follows 40 but lies back as well
    data = [("w", "a", i, t + dt.timedelta(minutes=m)) for i, m in enumerate(at)]
    ddl = "waterbody string, station string, seq int, timestamp timestamp"
    run = lambda stream: jobs.check_steps(stream, "seq", str(tmp_path / "out"), str(tmp_path / "cp"), 2, "1 hour").awaitTermination()
    arrivals(spark, tmp_path, [data[:5], data[5:9], data[9:]], ddl, run)
    assert rows(jobs.step_violations(spark, str(tmp_path / "out")), "seq") == [(9,)]
    assert len(list((tmp_path / "out" / "last").glob("batch=*"))) <= 2


# --- snapshots -------------------------------------------------------------------------------------


def batch_folders(path, numbers, changed=7):
    """Batches as ``update_to`` leaves them: a few keys each, later ones over earlier ones."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    truth = {}
    for b in numbers:
        rnd = random.Random(b)
        held = {(dt.datetime(2024, 1 + rnd.randrange(3), 1 + rnd.randrange(4)), rnd.choice(["s", "t", None])): float(b) for _ in range(changed)}
        truth |= held
        folder = path / f"batch={b}"
        folder.mkdir(parents=True)
        table = pa.table({"start": pa.array([k[0] for k in held], pa.timestamp("us", "UTC")), "station": pa.array([k[1] for k in held], pa.string()), "val": list(held.values())})
        pq.write_table(table, folder / "part-0.parquet")
        (folder / "_SUCCESS").touch()
    return truth


KEYS = ("start", "station")


def newest(spark, path):
    got = jobs.latest(spark, str(path), KEYS).collect()
    assert len(got) == len({(r.start, r.station) for r in got})
    return {(r.start, r.station): r.val for r in got}


def folders_read(spark, path):
    return {f.rsplit("/", 1)[0] for f in jobs.latest(spark, str(path), KEYS).inputFiles()}


def test_reading_stays_bounded_over_many_batches(spark, tmp_path):
    truth = {}
    for first in range(0, 1000, 200):
        truth |= batch_folders(tmp_path / "f", range(first, first + 200))
        snapshots.fold(spark, str(tmp_path / "f"), KEYS, F.date_trunc("month", "start"), below=first + 195)
        assert newest(spark, tmp_path / "f") == truth
        assert len(folders_read(spark, tmp_path / "f")) <= 3 + 5
    left = [p.name for p in (tmp_path / "f").glob("batch=*")]
    assert len(left) <= 205 and snapshots.manifest(spark, str(tmp_path / "f"))["upto"] == 994
    again = snapshots.fold(spark, str(tmp_path / "f"), KEYS, F.date_trunc("month", "start"))
    assert again["upto"] == 999 and newest(spark, tmp_path / "f") == truth
    assert snapshots.fold(spark, str(tmp_path / "f"), KEYS, F.date_trunc("month", "start")) == again


def test_killed_fold_leaves_a_readable_table(spark, tmp_path, monkeypatch):
    path, month = tmp_path / "f", F.date_trunc("month", "start")
    truth = batch_folders(path, range(4))
    snapshots.fold(spark, str(path), KEYS, month)
    truth |= batch_folders(path, range(4, 9))
    held = jobs.latest(spark, str(path), KEYS)

    def killed(*a):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(snapshots.folders, "write_whole", killed)
        with pytest.raises(RuntimeError, match="killed"):
            snapshots.fold(spark, str(path), KEYS, month)
    assert newest(spark, path) == truth
    (path / "batch=9").mkdir()  # begun and not finished: read by nobody
    snapshots.fold(spark, str(path), KEYS, month)
    assert newest(spark, path) == truth
    assert {(r.start, r.station): r.val for r in held.collect()} == truth  # a reader of the version before goes on


def test_only_touched_periods_are_rewritten(spark, tmp_path):
    ddl, month = "start timestamp, station string, val double", F.date_trunc("month", "start")
    put = lambda b, *r: spark.createDataFrame(list(r), ddl).write.parquet(str(tmp_path / f"batch={b}"))
    t = lambda m: dt.datetime(2024, m, 2)
    put(0, (t(1), "s", 1.0), (t(2), "s", 1.0), (None, "s", 1.0))
    snapshots.fold(spark, str(tmp_path), KEYS, month)
    put(1, (t(2), "s", 2.0))
    assert snapshots.fold(spark, str(tmp_path), KEYS, month)["periods"] == {"2024-01-01": 1, "2024-02-01": 2, "none": 1}
    assert newest(spark, tmp_path) == {(t(1), "s"): 1.0, (t(2), "s"): 2.0, (None, "s"): 1.0}


def test_stream_folds_while_it_runs(spark, feed):
    src, batch, tmp = feed
    means = jobs.window_means(jobs.sensor_readings(jobs.read_feed(spark, src, batch.schema, 1), ("temp_f",)).withWatermark("timestamp", "2 hours"), "1 hour")
    keys = ["start", *jobs.SERIES]
    jobs.update_to(means, f"{tmp}/folded", f"{tmp}/c6", keys, F.date_trunc("day", "start"), fold_every=2).awaitTermination()
    jobs.update_to(means, f"{tmp}/plain", f"{tmp}/c7").awaitTermination()
    read = lambda p: {tuple(r[k] for k in keys): (r["n"], r["val"]) for r in jobs.latest(spark, f"{tmp}/{p}", keys).collect()}
    assert read("folded") == read("plain") and snapshots.manifest(spark, f"{tmp}/folded")["upto"] >= 1


@pytest.mark.parametrize("method", ["complete", "recent", "shortest"])
def test_moments_equal_the_refit(spark, method):
    rnd = random.Random(3)
    keys, day0 = ("waterbody", "station"), D(2001, 1, 17)
    data = [("w", s, day0 + dt.timedelta(days=rnd.randrange(span)), rnd.gauss(1e6, 3)) for s, n, span in (("a", 900, 5000), ("b", 40, 60), (None, 200, 1500), ("one", 1, 1)) for _ in range(n)]
    data = [*{r[:3]: r for r in data}.values(), ("w", "flat", D(2002, 2, 2), 5.0), ("w", "gone", D(2001, 5, 5), None), ("w", "gone", D(2001, 5, 6), None)]
    daily = spark.createDataFrame(data, "waterbody string, station string, date date, val double")
    other = spark.createDataFrame([("w", "a", D(2003, 3, 9), D(2006, 8, 21)), ("w", "b", D(2020, 1, 1), D(2020, 1, 9))], "waterbody string, station string, lo date, hi date")
    asked = {"method": method, "years_back": 2, "other_span": other if method == "shortest" else None}
    table = moments.month_moments(daily, keys)
    got = moments.with_fits(daily, moments.fits(table, daily, keys, **asked), keys)
    show = lambda df: {(r.station, r.date): r.trend for r in df.collect()}
    a, b = show(got), show(trend.with_trend(daily, keys, **asked))
    assert a.keys() == b.keys() and {k for k in a if a[k] is None} == {k for k in b if b[k] is None}
    assert sum(v is not None for v in a.values()) > (100 if method != "complete" else 1000)
    assert all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a if a[k] is not None)


def test_refit_reads_moments_and_border_months_only(spark, tmp_path):
    rnd = random.Random(4)
    t = dt.datetime(2020, 1, 10)
    rows = [("w", s, "temp_f", t + dt.timedelta(hours=6 * i), rnd.gauss(70, 4)) for s in "ab" for i in range(4000)]
    parts = [rows[:2500] + rows[4000:6000], rows[2500:3000] + rows[6000:], rows[3000:4000]]
    run = lambda stream: jobs.moments_to(stream, f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    arrivals(spark, tmp_path, parts, READING, run)
    frame = spark.createDataFrame(rows, READING)
    daily = frame.groupBy(*jobs.SERIES, F.to_date("timestamp").alias("date")).agg(F.avg("val").alias("val"))
    for method in ("complete", "recent"):
        lines = jobs.refit_touched(spark, f"{tmp_path}/t", frame.filter("station = 'a'"), method=method, years_back=1)
        assert [r.station for r in lines.collect()] == ["a"]
        got = {r.date: r.trend for r in moments.with_fits(daily.filter("station = 'a'"), lines, jobs.SERIES).collect()}
        want = {r.date: r.trend for r in trend.with_trend(daily.filter("station = 'a'"), jobs.SERIES, method, 1).collect()}
        assert {d for d in got if got[d] is None} == {d for d in want if want[d] is None}
        assert all(got[d] == pytest.approx(want[d], rel=1e-9) for d in got if got[d] is not None)
    before = lines.first()
    # with the daily rows of all months but the first of the range gone, the fit is the same
    last = max(got)
    border = f"{last.replace(year=last.year - 1):%Y-%m}"
    for folder in (tmp_path / "t" / "daily").glob("month=*"):
        if folder.name != f"month={border}":
            shutil.rmtree(folder)
    again = jobs.refit_touched(spark, f"{tmp_path}/t", frame.filter("station = 'a'"), method="recent", years_back=1).first()
    assert again.n == before.n and again.slope == pytest.approx(before.slope, rel=1e-9) and again.n == sum(v is not None for v in got.values())


def test_continuous_batch(spark, rows):
    df = spark.createDataFrame(wide(), WIDE).drop("seq")
    st = spark.createDataFrame([("w", "0", "Name", 1.0, 2.0)], "waterbody string, station string, WATERBODY_NAME string, lon double, lat double")
    out = continuous.continuous_station_mean(df, st, "temp", "2024-01-01", "2024-01-02")
    assert rows(out, "station", "WATERBODY_NAME") == [("0", "Name"), ("1", None), ("2", None)]
    day = continuous.continuous_period(df, "sal", "day")
    assert day.agg(F.sum("n")).first()[0] == sum(1 for r in wide() if r[5] is not None)
    assert all(r["lovl"] < r["val"] < r["hivl"] for r in day.collect())
