from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import periods, trend

D = dt.date
SERIES = "waterbody string, station string, parameter string, location string, date date, val double"


def frame(spark, points, parameter="temp", w="w"):
    return spark.createDataFrame([(w, "1", parameter, "surf", d, float(v)) for d, v in points], SERIES)


def stats(rows, df, period):
    return rows(periods.period_stats(df, period), "date", "n", "val", "lovl", "hivl")


def test_interval_single_constant_pair(spark, rows):
    assert stats(rows, frame(spark, [(D(2020, 1, 1), 3)]), "year") == [(D(2020, 1, 1), 1, 3.0, None, None)]
    assert stats(rows, frame(spark, [(D(2020, 1, i), 2) for i in (1, 2, 3)]), "year") == [(D(2020, 1, 1), 3, 2.0, None, None)]
    assert stats(rows, frame(spark, [(D(2020, 1, i), 0.1) for i in range(1, 29)]), "winter") == [(D(2020, 1, 1), 28, pytest.approx(0.1), None, None)]
    (r,) = stats(rows, frame(spark, [(D(2020, 1, 1), 1), (D(2020, 1, 2), 3)]), "year")
    assert r[2] == 2 and r[3] == pytest.approx(-10.7062, abs=1e-4) and r[4] == pytest.approx(14.7062, abs=1e-4)


def test_season_runs(spark, rows):
    pts = [(D(2020, 12, 5), 1), (D(2021, 1, 5), 3), (D(2021, 3, 5), 5), (D(2021, 12, 5), 7)]
    got = [(r[0], r[1], r[2]) for r in stats(rows, frame(spark, pts), "season")]
    assert got == [(D(2020, 12, 1), 2, 2.0), (D(2021, 3, 1), 1, 5.0), (D(2021, 12, 1), 1, 7.0)]


def test_gap_does_not_split_a_season(spark, rows):
    pts = [(D(2000, 1, 5), 1), (D(2001, 2, 5), 3)]
    assert [(r[0], r[1]) for r in stats(rows, frame(spark, pts), "winter")] == [(D(2000, 1, 1), 2)]


def test_wet_dry(spark, rows):
    pts = [(D(2020, 5, 5), 1), (D(2020, 6, 5), 2), (D(2020, 9, 5), 4), (D(2020, 10, 5), 8)]
    assert [r[:3] for r in stats(rows, frame(spark, pts), "wet season")] == [(D(2020, 6, 1), 2, 3.0)]
    assert [r[:3] for r in stats(rows, frame(spark, pts), "dry season")] == [(D(2020, 5, 1), 1, 1.0), (D(2020, 10, 1), 1, 8.0)]


def test_rain_sums(spark, rows):
    pts = [(D(2020, m, 1), m) for m in range(1, 7)]
    assert stats(rows, frame(spark, pts, "rain"), "year") == [(D(2020, 1, 1), 6, 21.0, None, None)]
    by_season = stats(rows, frame(spark, pts, "rain"), "season")
    assert sum(r[2] for r in by_season) == 21.0 and all(r[3] is None for r in by_season)


def test_period_statistics_against_brute_force(spark, rows):
    """Combining monthly parts gives the statistics of the raw values."""
    rnd = random.Random(3)
    pts = [(D(2015, 1, 1) + dt.timedelta(days=rnd.randrange(1500)), 1000 + rnd.random()) for _ in range(3000)]
    pts.sort()
    label = lambda d: {12: "w", 1: "w", 2: "w"}.get(d.month) or ("p" if d.month < 6 else "s" if d.month < 9 else "f")
    runs, last = [], None
    for d, v in pts:
        if label(d) != last:
            runs.append((D(d.year, d.month, 1), []))
            last = label(d)
        runs[-1][1].append(v)
    got = {r[0]: r[1:] for r in stats(rows, frame(spark, pts), "season")}
    assert len(got) == len(runs)
    for start, vs in runs:
        n, m, lo, hi = got[start]
        assert n == len(vs) and math.isclose(m, statistics.fmean(vs), rel_tol=1e-12)
        half = 1.96 * statistics.stdev(vs) / math.sqrt(n)
        assert math.isclose(hi - lo, 2 * half, rel_tol=0.05) and lo < m < hi


def test_bad_period(spark):
    with pytest.raises(ValueError):
        periods.period_stats(frame(spark, [(D(2020, 1, 1), 1)]), "decade")


K = ("waterbody", "station")


@pytest.mark.parametrize("fit", ["daily", "rows"])
def test_trend_line(spark, rows, fit):
    pts = [(D(2020, 1, 1), 1), (D(2020, 1, 2), 2), (D(2020, 1, 4), 4)]
    f = (lambda df, m, **k: trend.with_trend(df, K, m, **k)) if fit == "daily" else (lambda df, m, **k: trend.with_row_trend(df, K, trend.days(F.col("date")), m, **k))
    out = rows(f(frame(spark, pts), "complete"), "val", "trend")
    assert all(v == pytest.approx(t) for v, t in out)
    # one row: none; one date twice: flat at the mean
    assert rows(f(frame(spark, pts[:1]), "complete"), "trend") == [(None,)]
    assert rows(f(frame(spark, [(D(2020, 1, 1), 1), (D(2020, 1, 1), 3)]), "complete"), "trend") == [(2.0,), (2.0,)]
    # shorter than the window: none at all
    assert rows(f(frame(spark, pts), "recent"), "trend") == [(None,)] * 3
    long = [(D(2000, 1, 1), 100), (D(2012, 1, 1), 1), (D(2015, 1, 1), 2), (D(2020, 1, 1), 3)]
    got = dict(rows(f(frame(spark, long), "recent"), "date", "trend"))
    assert got[D(2000, 1, 1)] is None and got[D(2015, 1, 1)] == pytest.approx(2.0, abs=0.2)
    # shortest: the other side's shorter range; ties keep the own range; an empty other side means complete
    other = spark.createDataFrame([("w", "1", D(2012, 1, 1), D(2015, 1, 1))], "waterbody string, station string, lo date, hi date")
    got = dict(rows(f(frame(spark, long), "shortest", other_span=other), "date", "trend"))
    assert got[D(2000, 1, 1)] is None and got[D(2020, 1, 1)] is None and got[D(2012, 1, 1)] == pytest.approx(1.0)
    tie = spark.createDataFrame([("w", "1", D(1999, 1, 1), D(2019, 1, 1))], "waterbody string, station string, lo date, hi date")
    assert None not in dict(rows(f(frame(spark, long), "shortest", other_span=tie), "date", "trend")).values()
    assert None not in dict(rows(f(frame(spark, long), "shortest", other_span=other.limit(0)), "date", "trend")).values()


def test_trend_shortest_without_overlap_has_no_line(spark, rows):
    pts = [(D(2000, 1, 1), 1), (D(2001, 1, 1), 2)]
    other = spark.createDataFrame([("w", "1", D(2010, 1, 1), D(2010, 2, 1))], "waterbody string, station string, lo date, hi date")
    assert rows(trend.with_trend(frame(spark, pts), K, "shortest", other_span=other), "trend") == [(None,), (None,)]


def test_trend_coefficients(spark):
    pts = [(D(2020, 1, 1 + i), 3 + 2 * i) for i in range(5)]
    r = trend.trend_coefficients(frame(spark, pts), K, trend.days(F.col("date")), F.col("val")).first()
    assert r["slope"] == pytest.approx(2.0) and r["n"] == 5 and r["mean"] == 7.0
