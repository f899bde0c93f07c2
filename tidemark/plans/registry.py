"""Named queries over the test tables: (spark, folder) -> DataFrame.

Floats are rounded to six decimals and dates written as text, so that results
compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.functions import dates, text, values
from tidemark.functions.labels import parameter_label
from tidemark.operators import checks, choices, clean, continuous, criteria, filters, joins, moments, periods
from tidemark.operators import rain, reshape, series, spatial, summary, trend
from tidemark.plans import build, queries
from tidemark.plans import workload as w
from tidemark.session import saved, scratch_dir
from tidemark.sources import export, polygons, rain_payloads, sheets, tables
from tidemark.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END = "1996-01-01", "2000-12-31"


def six_decimals(c: Column) -> Column:
    """Rounded for comparison. The added billionth lifts values that are an exact half but for
    summation noise, so every engine rounds them the same way."""
    return F.round(c + F.lit(1e-9), 6) + F.lit(0.0)


def settle(df: DataFrame) -> DataFrame:
    """Six decimals, no negative zero, dates and times as text."""

    def show(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return six_decimals(c).alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        return c

    return df.select(*[show(f) for f in df.schema.fields])


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, folder: settle(fn(spark, folder))
    return fn


# --- area and comparison summaries -------------------------------------------------------------


@query
def region_summary(spark, d):
    out = queries.area_map(w.samples(spark, d, ["temp"]), w.stations(spark, d), w.regions(spark, d), "region", "temp", "surf", START, END)
    return out.select("WBID", "WATERBODY_NAME", "val", "n_stations", "stas", "hover")


@query
def station_summary(spark, d):
    out = queries.area_map(w.samples(spark, d, ["temp"]), w.stations(spark, d), w.regions(spark, d), "station", "temp", "surf", START, END)
    return out.select("stas", "waterbody", "station", "val", "WATERBODY_NAME", "lon", "lat", "hover")


def _compare(spark, d, by, a, b, by_location=False):
    names = {text.split_key(c)[0] for c in (a, b)}
    rain_tables = {}
    if "rain" in names:
        rain_tables = {"rain": w.rain_monthly(spark, d), "gauges": w.gauges(spark, d), "rain_regions": w.regions(spark, d)}
    return summary.compare_summary(
        w.samples(spark, d, sorted(names - {"rain"})), w.stations(spark, d), w.regions(spark, d), by, a, b, START, END,
        by_location=by_location, **rain_tables,
    )


@query
def compare_region(spark, d):
    return _compare(spark, d, "region", "temp_surf", "tp_bott").select("WBID", "WATERBODY_NAME", "parameter", "val", "n_stations", "stas")


@query
def compare_region_blended(spark, d):
    return _compare(spark, d, "region", "temp_surf", "temp_bott").select("WBID", "parameter", "val", "stas")


@query
def compare_region_by_location(spark, d):
    return _compare(spark, d, "region", "temp_surf", "temp_bott", True).select("WBID", "parameter", "location", "val", "stas")


@query
def compare_station(spark, d):
    return _compare(spark, d, "station", "temp_surf", "tp_bott").select("stas", "waterbody", "station", "parameter", "val", "lon", "lat")


@query
def compare_region_rain(spark, d):
    return _compare(spark, d, "region", "temp_surf", "rain").select("WBID", "WATERBODY_NAME", "parameter", "val", "n_stations", "stas")


@query
def compare_station_rain(spark, d):
    return _compare(spark, d, "station", "tn_bott", "rain").select("stas", "waterbody", "station", "parameter", "val")


# --- daily and monthly series ------------------------------------------------------------------


@query
def region_daily(spark, d):
    return series.region_daily(w.samples(spark, d, ["temp"]), w.stations(spark, d), "temp", "surf", START, END).orderBy("WBID", "date")


@query
def station_daily(spark, d):
    return series.station_daily(w.samples(spark, d, ["temp"]), "temp", "surf", START, END)


@query
def region_daily_by_param(spark, d):
    return series.region_daily_by_parameter(w.samples(spark, d), w.stations(spark, d))


@query
def rain_monthly(spark, d):
    return w.rain_monthly(spark, d)


@query
def rain_month_parts(spark, d):
    return rain.monthly_by_part(w.rain_daily(spark, d))


@query
def rain_gaps_parts(spark, d):
    """Monthly totals of rain with missing values and dates."""
    return rain.monthly_by_part(w.rain_gaps(spark, d))


@query
def rain_gaps_distribution(spark, d):
    return rain.rain_distribution(w.rain_gaps(spark, d))


@query
def rain_by_choice(spark, d):
    return filters.gauge_or_region(joins.with_gauge(w.rain_monthly(spark, d), w.gauges(spark, d)), "R1")


@query
def rain_region_series(spark, d):
    return series.rain_series(w.rain_monthly(spark, d), w.gauges(spark, d), "region")


# --- period means with intervals, period totals --------------------------------------------------


def _side(spark, d, by, choice, period, start=None, end=None):
    p = text.split_key(choice)[0]
    if p == "rain":
        return queries.comparison_side(
            None, w.stations(spark, d), by, choice, start, end, period, rain=w.rain_monthly(spark, d), gauges=w.gauges(spark, d)
        )
    return queries.comparison_side(w.samples(spark, d, [p]), w.stations(spark, d), by, choice, start, end, period)


@query
def period_year_ci(spark, d):
    return _side(spark, d, "region", "temp_surf", "year")


@query
def period_station_raw_ci(spark, d):
    return _side(spark, d, "station", "temp_surf", "year")


@query
def period_season_ci(spark, d):
    return _side(spark, d, "station", "temp_surf", "season")


@query
def period_one_season(spark, d):
    return _side(spark, d, "region", "tp_bott", "winter")


@query
def period_wet(spark, d):
    return _side(spark, d, "region", "temp_surf", "wet season")


@query
def period_dry(spark, d):
    return _side(spark, d, "station", "tn_bott", "dry season")


@query
def period_rain_year(spark, d):
    return _side(spark, d, "station", "rain", "year")


@query
def period_rain_season(spark, d):
    return _side(spark, d, "region", "rain", "season")


@query
def season_runs(spark, d):
    months = (
        filters.select_samples(w.samples(spark, d, ["temp"]), "temp", "surf")
        .select("waterbody", "station", dates.month_floor(F.col("date")).alias("month")).distinct()
        .withColumn("label", dates.season(F.col("month")))
    )
    return periods.with_runs(months, ("waterbody", "station"))


# --- trends --------------------------------------------------------------------------------------


def _area_series(spark, d, by, parameter, show, years=9, start=None, end=None):
    return queries.area_series(
        w.samples(spark, d, [parameter]), w.stations(spark, d), w.criteria(spark, d), by, parameter, "surf", start, end, show, years
    )


@query
def trend_complete(spark, d):
    return _area_series(spark, d, "region", "temp", "complete").select("WBID", "date", "val", "trend")


@query
def trend_recent(spark, d):
    return _area_series(spark, d, "station", "temp", "recent", 3).select("waterbody", "station", "date", "val", "trend")


@query
def trend_recent_too_short(spark, d):
    return _area_series(spark, d, "region", "tp", "recent", 9).select("WBID", "date", "val", "trend")


@query
def trend_shortest(spark, d):
    side = _side(spark, d, "station", "temp_surf", "none")
    other = _side(spark, d, "station", "temp_bott", "none")
    out = queries.comparison_series(side, other, w.criteria(spark, d), "station", "shortest")
    return out.select("waterbody", "station", "date", "val", "trend")


def _pairs(spark, d, other):
    """Each listed station with the area that ``other`` names by waterbody and station."""
    st = w.stations(spark, d).select("waterbody", "station")
    return other(st).select(*queries.PAIR)


@query
def pair_stations(spark, d):
    """Two chosen stations: each with the one of the next number, fitted inside the shorter of both ranges."""
    def following(st):
        nxt = st.select(F.col("waterbody").alias("other_waterbody"), F.col("station").alias("other_station"))
        return st.join(nxt, F.col("station").cast("long") + 1 == F.col("other_station").cast("long"))

    sides = [_side(spark, d, "station", c, "none") for c in ("temp_surf", "temp_bott")]
    out = queries.comparison_series(*sides, w.criteria(spark, d), "station", "shortest", pairs=_pairs(spark, d, following))
    return out.select(*queries.PAIR, "date", "val", "trend")


@query
def pair_station_gauge(spark, d):
    """A station and a gauge, the station's readings of one and a half years against the rain of a gauge."""
    def gauge(st):
        named = w.gauges(spark, d).select(F.col("name").alias("other_waterbody"), F.col("station").alias("other_station"))
        return st.join(named, F.concat(F.lit("G"), (F.col("station").cast("long") % 7).cast("string")) == F.col("other_station"))

    side = _side(spark, d, "station", "temp_surf", "none")
    rained = _side(spark, d, "station", "rain", "none", "1994-07-01", "1995-12-31")
    out = queries.comparison_series(side, rained, w.criteria(spark, d), "station", "shortest", pairs=_pairs(spark, d, gauge))
    return out.select(*queries.PAIR, "date", "val", "trend")


@query
def trend_shortest_region(spark, d):
    side = _side(spark, d, "region", "temp_surf", "none")
    other = _side(spark, d, "region", "rain", "none")
    out = queries.comparison_series(side, other, w.criteria(spark, d), "region", "shortest")
    return out.select("waterbody", "date", "val", "trend")


def _moment_trend(spark, d, parameter, by, method, years=9):
    """A daily series whose trend is read off its monthly moments."""
    keys = ("WBID",) if by == "region" else ("waterbody", "station")
    daily = _area_series(spark, d, by, parameter, "none").select(*keys, "date", "val")
    lines = moments.fits(moments.month_moments(daily, keys), daily, keys, method, years)
    return moments.with_fits(daily, lines, keys)


@query
def moments_complete(spark, d):
    return _moment_trend(spark, d, "temp", "region", "complete")


@query
def moments_recent(spark, d):
    return _moment_trend(spark, d, "temp", "station", "recent", 3)


@query
def moments_shortest(spark, d):
    """Stations' daily means, fitted inside the shorter of their own range and that of their bottom readings."""
    keys = ("waterbody", "station")
    daily = _area_series(spark, d, "station", "temp", "none").select(*keys, "date", "val")
    other = trend.span(_side(spark, d, "station", "temp_bott", "none"), keys)
    lines = moments.fits(moments.month_moments(daily, keys), daily, keys, "shortest", other_span=other)
    return moments.with_fits(daily, lines, keys)


@query
def selected_station(spark, d):
    return queries.selected(_side(spark, d, "station", "temp_surf", "year"), "NATION_15_0")


@query
def selected_region(spark, d):
    return queries.selected(_side(spark, d, "region", "tn_bott", "season"), "R1")


@query
def selected_none(spark, d):
    return queries.selected(_side(spark, d, "region", "tn_bott", "year"), None)


@query
def trend_period(spark, d):
    side = _side(spark, d, "region", "temp_surf", "year")
    out = queries.comparison_series(side, side, w.criteria(spark, d), "region", "complete")
    return out.select("waterbody", "date", "val", "trend", "criterion")


# --- criteria and gauges -------------------------------------------------------------------------


@query
def criteria_lookup(spark, d):
    c = w.criteria(spark, d)
    region = criteria.unique_criteria(c, "region").select(F.col("WBID").alias("area"), "parameter", "value")
    station = criteria.unique_criteria(c, "station").select(
        text.build_key(F.col("waterbody"), F.col("station")).alias("area"), "parameter", "value"
    )
    return region.unionByName(station)


@query
def series_with_criterion(spark, d):
    return _area_series(spark, d, "region", "chlcorr", "none").select("WBID", "date", "val", "criterion")


def _gauge(spark, d, by, parameter):
    return queries.area_gauge(
        w.samples(spark, d, [parameter]), w.stations(spark, d), w.regions(spark, d), w.criteria(spark, d), by, parameter, "surf", START, END
    )


@query
def gauge(spark, d):
    return _gauge(spark, d, "region", "tn").select("WBID", "shown", "scale_min", "scale_max", "criterion", "unit")


@query
def gauge_station(spark, d):
    return _gauge(spark, d, "station", "tp").select("stas", "shown", "scale_min", "scale_max", "criterion", "unit")


@query
def gauge_celsius(spark, d):
    return _gauge(spark, d, "region", "temp").select("WBID", "shown", "shown_celsius", "scale_max", "unit")


# --- catalogue, spans, overview, pick-lists --------------------------------------------------------


@query
def param_catalogue(spark, d):
    return summary.catalogue(w.samples(spark, d))


@query
def station_span(spark, d):
    return summary.with_span(w.stations(spark, d), w.samples(spark, d)).select("waterbody", "station", "datestr", "dateend")


@query
def overview(spark, d):
    return summary.overview(w.samples(spark, d), w.stations(spark, d))


@query
def param_choices(spark, d):
    s = w.samples(spark, d)
    return choices.parameter_choices(s, w.rain_monthly(spark, d), summary.catalogue(s), "1996-01-01", "2024-12-31")


@query
def parameter_list(spark, d):
    return choices.parameter_list(summary.catalogue(w.samples(spark, d)))


@query
def location_choices(spark, d):
    return choices.location_choices(summary.catalogue(w.samples(spark, d)))


@query
def date_choices(spark, d):
    return choices.date_choices(w.samples(spark, d, ["temp", "tp"]), location=["surf"])


@query
def waterbody_list(spark, d):
    return choices.waterbody_list(w.samples(spark, d))


@query
def axis_labels(spark, d):
    return choices.axis_labels_with_rain(summary.catalogue(w.samples(spark, d)))


@query
def titles(spark, d):
    return choices.area_titles(w.stations(spark, d))


@query
def export_filtered(spark, d):
    return queries.export_rows(
        w.samples(spark, d, ["temp", "tn"]), ["NATION_1", "NATION_3", "NATION_20"], ["temp", "tn"], START, END
    )


@query
def table_view(spark, d):
    rows = queries.export_rows(w.samples(spark, d, ["tp"]), ["NATION_1", "NATION_3", "NATION_20"], ["tp"], START, END)
    return filters.table_view(rows)


@query
def export_csv(spark, d):
    path = scratch_dir(spark, "export")
    daily = region_daily(spark, d).withColumns({"val": six_decimals(F.col("val")), "note": F.lit(None).cast("string")})
    export.write_export(daily, path)
    lines = spark.read.text(path)
    return lines.filter(F.col("value") != '"WBID","date","val","note"').select(F.col("value").alias("line"))


@query
def table_round_trip(spark, d):
    folder = scratch_dir(spark, "tables")
    tables.save_table(w.samples(spark, d), folder, "samples")
    back = tables.load_table(spark, folder, "samples")
    return back.groupBy("type", "parameter", "location").agg(
        F.count("*").alias("n"), F.count("val").alias("n_val"), F.sum("val").alias("total"), F.min("date").alias("first")
    )


# --- cleaning and reshaping ------------------------------------------------------------------------


def _wide_field(spark, d):
    line = w.table(spark, d, "lineitem").join(w._keys(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
    surf, ok = F.col("l_linestatus") == "O", ~w._missing()
    return line.select(
        "county", "waterbody", "station", F.to_date("l_shipdate").alias("date"),
        F.when(surf & ok, F.col("l_quantity")).alias("temp_surf_f"),
        F.when(~surf & ok, F.col("l_quantity")).alias("temp_bott_f"),
        F.when(ok, F.col("l_discount")).alias("tn_mgl"),
    )


@query
def unpivot_samples(spark, d):
    return reshape.to_long(_wide_field(spark, d))


@query
def split_names(spark, d):
    three = reshape.split_variable(reshape.to_long(_wide_field(spark, d)), ("parameter", "location", "units"))
    return filters.valid(three).groupBy("parameter", "location", "units").agg(
        F.count("*").alias("n"), F.sum("val").alias("total")
    )


@query
def tagged_union(spark, d):
    p = w.physical(spark, d).drop("type", "notes")
    c = w.discrete(spark, d).drop("type")
    return reshape.tidy_samples(physical=p, discrete=c).groupBy("type", "county", "parameter", "location", "units").agg(
        F.count("*").alias("n"), F.count("notes").alias("n_notes"), F.sum("val").alias("total")
    )


@query
def notes_join(spark, d):
    keys = ["county", "waterbody", "station", "date", "parameter", "val"]
    lab = w.discrete(spark, d).select(*keys, "location", "units", "notes")
    return joins.attach_notes(lab, lab, keys)


@query
def clean_scrub(spark, d):
    return w.dirty(spark, d).select("key", values.to_number(values.scrub(values.null_tokens(F.col("number")))).alias("number"))


@query
def clean_waterbody(spark, d):
    return w.dirty(spark, d).select("key", values.replace_in_order(F.col("waterbody"), S.WATERBODY_FIXES).alias("waterbody"))


@query
def clean_units(spark, d):
    return w.dirty(spark, d).select(
        "key",
        values.conductivity(F.col("ms"), F.col("us")).alias("cond"),
        values.thousandth(F.col("us")).alias("mgl"),
        F.round(values.celsius(F.col("us")), 2).alias("celsius"),
        values.clamp_zero(F.col("us") - 1000).alias("clamped"),
        text.unit_of_label(parameter_label(F.lit("tp"), F.lit("mgl"))).alias("unit"),
    )


@query
def note_depth(spark, d):
    n = F.col("note")
    return w.dirty(spark, d).select(
        "key", values.note_depth(F.col("depth"), n).alias("depth"), values.on_bottom(n).alias("flag"),
        values.on_bottom_note(values.on_bottom(n)).alias("notes"),
    )


@query
def recode(spark, d):
    return w.dirty(spark, d).select(
        "key", values.recode(F.col("county"), S.COUNTY_RECODE).alias("county"),
        values.recode(F.col("WBID"), S.CRITERIA_REGION_RECODE).alias("WBID"),
    )


@query
def capitalise(spark, d):
    return w.dirty(spark, d).select("key", text.capitalise(F.col("title")).alias("title"))


@query
def dates_typed(spark, d):
    day = dates.parse_mdy(F.col("day"))
    return w.dirty(spark, d).select(
        "key", day.alias("date"), dates.month_floor(day).alias("month"), dates.year_floor(day).alias("year"),
        dates.period_floor(day, "week").alias("week"), dates.wet_dry(day).alias("wetdry"), dates.season(day).alias("season"),
        dates.epoch_ms(day).alias("ms"),
    )


@query
def exclude_stations(spark, d):
    gone = w.stations(spark, d).filter("WBID IS NULL").select("waterbody", "station")
    kept = joins.exclude(w.samples(spark, d, ["temp"]), gone)
    return kept.groupBy("waterbody").agg(F.count("*").alias("n"), F.count_distinct("station").alias("n_stations"))


@query
def build_samples(spark, d):
    gone = w.stations(spark, d).filter("WBID IS NULL").select(
        F.concat(F.lit("GAP "), F.col("waterbody")).alias("waterbody"), "station"
    )

    def sheet(df):
        return df.select(*[values.null_tokens(F.col(f"`{c}`")).alias(c) for c in df.columns])

    out = build.build_samples(sheet(w.raw_field(spark, d)), sheet(w.raw_lab(spark, d)), gone)
    return out.groupBy("type", "county", "waterbody", "parameter", "location", "units").agg(
        F.count("*").alias("n"), F.sum("val").alias("total"), F.count("notes").alias("n_notes"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )


def _as_sheet(df, spark, name, empty="NA"):
    """Write a frame as a CSV sheet with headings."""
    path = scratch_dir(spark, name)
    df.write.option("header", True).option("nullValue", empty).csv(path)
    return path


def _as_two_files(df, spark, name, empty="NA"):
    """A sheet in files of two orders of columns, cells quoted where they hold commas or quotes."""
    path = scratch_dir(spark, name)
    half = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns[2:7]]), F.lit(2)) == 0
    for part, rows, columns in (("a", half, df.columns), ("b", ~half, df.columns[::-1])):
        df.filter(rows).select(*[F.col(f"`{c}`") for c in columns]).write.options(header=True, nullValue=empty, escape='"').csv(f"{path}/{part}")
    return f"{path}/*"


@query
def full_sheets(spark, d):
    """``build_samples`` from whole sheets: every measured column, two orders of headings, remarks with commas, four spellings of dates."""
    out = build.build_samples(
        sheets.read_field_sheet(spark, _as_two_files(w.full_field(spark, d), spark, "full-field")),
        sheets.read_lab_sheet(spark, _as_two_files(w.full_lab(spark, d), spark, "full-lab", ".")),
    )
    return out.groupBy("type", "county", "waterbody", "parameter", "location", "units").agg(
        F.count("*").alias("n"), F.sum("val").alias("total"), F.count("notes").alias("n_notes"), F.count("date").alias("n_dates"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )


@query
def sheets_to_samples(spark, d):
    """``build_samples`` from CSV sheets on storage."""
    gone = w.stations(spark, d).filter("WBID IS NULL").select(
        F.concat(F.lit("GAP "), F.col("waterbody")).alias("waterbody"), "station"
    )
    out = build.build_samples(
        sheets.read_field_sheet(spark, _as_sheet(w.raw_field(spark, d), spark, "field")),
        sheets.read_lab_sheet(spark, _as_sheet(w.raw_lab(spark, d), spark, "lab", ".")),
        sheets.read_exclusions(spark, _as_sheet(gone, spark, "gone")),
    )
    return out.groupBy("type", "county", "waterbody", "parameter", "location", "units").agg(
        F.count("*").alias("n"), F.sum("val").alias("total"), F.count("notes").alias("n_notes"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )


@query
def station_sheet(spark, d):
    """The station list as a sheet whose two coordinate headings are exchanged."""
    back = {new: old for old, new in S.STATION_RENAMES.items()}
    src = w.stations(spark, d).withColumnRenamed("WBID", "WBIDorig").withColumn("abbr", F.lit("x"))
    sheet = src.select(*[F.col(c).alias(h) for c, h in back.items()], F.col("abbr").alias("GPS abbr."))
    return sheets.read_station_sheet(spark, _as_sheet(sheet, spark, "stations"))


@query
def criteria_sheet(spark, d):
    back = {new: old for old, new in S.CRITERIA_RENAMES.items()}
    sheet = w.criteria_wide(spark, d).select(*[F.col(c).alias(h) for c, h in back.items()])
    return build.build_criteria(sheets.read_criteria_sheet(spark, _as_sheet(sheet, spark, "criteria", ".")))


@query
def criteria_long(spark, d):
    return reshape.criteria_long(clean.clean_criteria(w.criteria_wide(spark, d)))


@query
def key_build(spark, d):
    return w.stations(spark, d).select(
        text.build_key(F.col("waterbody"), F.col("station")).alias("stas"), text.build_key(F.col("WBID"), F.col("station")).alias("other")
    )


@query
def key_split(spark, d):
    return w.station_keys(w.stations(spark, d)).select(
        "key", text.key_head(F.col("key")).alias("waterbody"), text.key_tail(F.col("key")).alias("station")
    )


@query
def pivot_wide(spark, d):
    long = continuous.continuous_long(w.readings(spark, d).drop("event_id"))
    daily = long.groupBy("waterbody", "station", F.to_date("timestamp").alias("date"), "variable").agg(F.max("val").alias("val"))
    return reshape.to_wide(daily, ["waterbody", "station", "date"], "variable", "val", ["temp_f", "sal_ppt"])


# --- regions and points ----------------------------------------------------------------------------


@query
def point_region_join(spark, d):
    pts = w.stations(spark, d).select("waterbody", "station", "lon", "lat")
    return spatial.locate(pts, w.polygons(spark))


@query
def regions_hit(spark, d):
    hit = build.build_regions(w.polygons(spark), w.stations(spark, d))
    return hit.select("WBID", "WATERBODY_NAME", F.size("rings").alias("n_rings"), "xmin", "ymax")


@query
def resolve_multi_region(spark, d):
    pts = w.stations(spark, d).select("waterbody", "station", "lon", "lat", F.when(F.col("WBID") == "R1", "P1").otherwise("P2").alias("WBIDorig"))
    return spatial.resolve_multiple(spatial.locate(pts, w.polygons(spark))).select("waterbody", "station", "WBID")


@query
def unresolved_stations(spark, d):
    pts = w.stations(spark, d).select("waterbody", "station", "lon", "lat", F.lit("P3").alias("WBIDorig"))
    return spatial.unresolved(spatial.locate(pts, w.polygons(spark)))


@query
def in_bbox(spark, d):
    return spatial.in_box(w.stations(spark, d), w.BOX).select("waterbody", "station", "lon", "lat")


@query
def geojson_regions(spark, d):
    """A feature per station, written line by line and read back: triangles, every third with a hole,
    and for every fifth station two triangles side by side."""
    path = scratch_dir(spark, "geojson")
    k = F.col("station").cast("bigint")

    def ring(dx, size):
        x, y = F.col("lon") + F.lit(dx), F.col("lat")
        return F.array(F.array(x, y), F.array(x + F.lit(size), y), F.array(x, y + F.lit(size)))

    plain = F.array(ring(0.0, 0.01))
    holed = F.array(ring(0.0, 0.01), ring(0.001, 0.002))
    shape = F.when(k % 5 == 0, F.to_json(F.array(plain, F.array(ring(0.02, 0.01))))).when(k % 3 == 0, F.to_json(holed))
    feature = F.format_string(
        '{"type":"Feature","properties":%s,"geometry":{"type":"%s","coordinates":%s}}',
        F.to_json(F.struct(F.col("station").alias("WBID"), F.col("name").alias("WATERBODY_NAME"))),
        F.when(k % 5 == 0, "MultiPolygon").otherwise("Polygon"),
        F.coalesce(shape, F.to_json(plain)),
    )
    w.stations(spark, d).select(feature.alias("value")).write.text(path)
    out = polygons.read_geojson(spark, path, lines=True)
    return out.select(
        "WBID", "WATERBODY_NAME", F.size("rings").alias("n_rings"), F.size(F.flatten("rings")).alias("n_points"),
        "xmin", "xmax", "ymin", "ymax",
    )


@query
def json_rain(spark, d):
    """Daily rain written as payloads, some of them without results, and read back into monthly totals."""
    path = scratch_dir(spark, "payloads")
    row = F.struct(
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.lit("PRCP").alias("datatype"),
        F.concat(F.lit("GHCND:"), F.col("station")).alias("station"), F.col("precip_inches").alias("value"),
    )
    empty = F.array().cast("array<struct<date:string,datatype:string,station:string,value:double>>")
    payload = F.explode(F.array(F.struct(F.array(row).alias("results")), F.struct(empty.alias("results"))))
    w.rain_daily(spark, d).select(payload.alias("p")).select(F.to_json("p").alias("value")).write.text(path)
    daily = rain_payloads.read_rain_payloads(spark, path, multi_line=False)
    return rain.rain_monthly(daily, {"G1": "first", "G2": "second", "G3": "third", "G4": "fourth"})


@query
def built_tables(spark, d):
    """Stations, regions, gauges and rain as ``build_all`` saves them from sheets, polygons and payloads."""
    st = w.stations(spark, d)
    sheet = st.withColumn("WBIDorig", F.when(F.col("WBID") == "R1", "P1").otherwise("P2"))
    stations = sheet.select(*[F.col(new).alias(old) for old, new in S.STATION_RENAMES.items()])
    criteria_wide = w.criteria_wide(spark, d).select(*[F.col(new).alias(old) for old, new in S.CRITERIA_RENAMES.items()])
    lake = st.filter("WBID IS NULL").select("waterbody", "station")
    shapes, payloads = scratch_dir(spark, "shapes"), scratch_dir(spark, "payloads")
    points = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    feature = F.format_string(
        '{"type":"Feature","properties":%s,"geometry":{"type":"Polygon","coordinates":%s}}', F.to_json(F.struct("WBID", "WATERBODY_NAME")), F.to_json(points)
    )
    w.polygons(spark).select(feature).write.text(shapes)
    row = F.struct(
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.lit("PRCP").alias("datatype"),
        F.concat(F.lit("GHCND:"), F.element_at(F.array(*[F.lit(x) for x in S.RAIN_STATIONS]), (F.substring("station", 2, 1).cast("int") % 3 + 1))).alias("station"),
        F.col("precip_inches").alias("value"),
    )
    w.rain_daily(spark, d).select(F.to_json(F.struct(F.array(row).alias("results")))).write.text(payloads)
    folder = scratch_dir(spark, "built")
    build.build_all(spark, {
        "field": _as_sheet(w.raw_field(spark, d), spark, "field"), "lab": _as_sheet(w.raw_lab(spark, d), spark, "lab", "."),
        "exclusions": _as_sheet(lake, spark, "gone"), "stations": _as_sheet(stations, spark, "stations"), "polygons": shapes, "rain": payloads,
        "criteria": _as_sheet(criteria_wide, spark, "criteria", "."),
    }, folder, lines=True)
    t = tables.load_tables(spark, folder, ("stations", "regions", "gauges", "rain"))
    none = F.lit(None).cast("string")
    parts = (
        ("stations", "stations", F.concat_ws("_", "waterbody", "station"), F.col("WBID"), F.col("WATERBODY_NAME"), F.col("lon")),
        ("regions", "regions", F.col("WBID"), F.col("WATERBODY_NAME"), none, F.col("xmin")),
        ("gauges", "gauges", F.col("station"), F.col("name"), F.col("WBID"), F.col("lon")),
        ("rain", "rain", F.col("station"), F.col("name"), F.date_format("date", "yyyy-MM-dd"), F.col("precip_inches")),
    )
    out = None
    for table, name, a, b, c, v in parts:
        rows = t[table].select(F.lit(name).alias("tab"), a.alias("a"), b.alias("b"), c.alias("c"), v.cast("double").alias("v"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- data quality ----------------------------------------------------------------------------------


def _listed(spark, d):
    """The stations of a list that lacks the ones without region."""
    return w.stations(spark, d).filter("WBID IS NOT NULL")


@query
def dq_physical_stations(spark, d):
    return checks.unknown_physical_stations(w.samples(spark, d), _listed(spark, d))


@query
def dq_discrete_stations(spark, d):
    return checks.unknown_discrete_stations(w.samples(spark, d), _listed(spark, d))


@query
def dq_continuous_stations(spark, d):
    return checks.unknown_continuous_stations(w.readings(spark, d), _listed(spark, d))


@query
def dq_time_steps(spark, d):
    """Field readings by station in order of their order key and line: most dates step backward somewhere."""
    line = w.table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("station"), F.col("l_shipdate").alias("timestamp"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("arrival"),
    )
    bad = checks.backward_steps(line, "arrival", F.floor(F.col("arrival.l_orderkey") / 20000), ("station",))
    return bad.groupBy("station").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"))


@query
def dq_counties(spark, d):
    return checks.county_mismatch(w.samples(spark, d), ("C0", "C1", "C2", "C9"))


@query
def dq_dates(spark, d):
    return checks.sample_dates_outside(w.samples(spark, d), "1995-06-01", "2023-12-31")


@query
def dq_locations_box(spark, d):
    return checks.stations_outside_box(w.stations(spark, d), w.BOX).select("waterbody", "station")


@query
def dq_criteria_stations(spark, d):
    return checks.stations_without_criteria(w.samples(spark, d), w.criteria(spark, d).filter("parameter = 'chl'"))


@query
def dq_criteria_regions(spark, d):
    return checks.criteria_unknown_regions(w.criteria(spark, d), w.regions(spark, d).filter("WBID <> 'R3'"))


@query
def dq_parameters(spark, d):
    s = w.samples(spark, d)
    return checks.parameters_without_entry(s, summary.catalogue(s).filter("label IS NOT NULL"))


@query
def dq_rain_values(spark, d):
    lowered = w.rain_daily(spark, d).withColumn("precip_inches", F.col("precip_inches") - 0.1)
    return checks.negative_rain(lowered)


@query
def dq_rain_dates(spark, d):
    return checks.rain_dates_outside(w.rain_monthly(spark, d), "1995-03-01", "2001-05-31")


@query
def dq_rain_gaps(spark, d):
    """Days outside the range with their rows, the missing day among them, and how many values are bad on each."""
    gaps = w.rain_gaps(spark, d)
    outside = checks.rain_dates_outside(gaps, "1995-03-01", "2001-05-31")
    bad = checks.negative_rain(gaps).groupBy("date").agg(F.count("*").alias("n_bad"))
    return joins.join_on(outside, bad, ["date"], "left")


@query
def dq_missing_dates(spark, d):
    s = w.samples(spark, d, ["temp"]).withColumn("date", F.when(F.dayofmonth("date") != 29, F.col("date")))
    return checks.sample_dates_outside(s, "1995-06-01", "1998-01-31")


@query
def dates_spelled(spark, d):
    return w.spelled_dates(spark, d).select("key", dates.parse_mdy(F.col("day")).alias("date"))


@query
def dq_rain_gauges(spark, d):
    return checks.unknown_gauges(w.rain_monthly(spark, d), w.gauges(spark, d).filter("WBID IS NOT NULL"))


@query
def dq_gauge_regions(spark, d):
    return checks.gauge_region_problems(w.gauges(spark, d), w.regions(spark, d).filter("WBID <> 'R2'"), ("R0", "R1", "R2"), 2)


@query
def dq_sample_locations(spark, d):
    wrong = w.samples(spark, d).withColumn("location", F.when(F.col("location") == "bott", "bottom").otherwise(F.col("location")))
    return checks.bad_locations(wrong)


@query
def dq_waterbodies(spark, d):
    return checks.waterbody_mismatch(w.samples(spark, d), ("NATION_0", "NATION_1", "NATION_99"))


@query
def dq_station_regions(spark, d):
    return checks.station_region_problems(w.stations(spark, d), w.regions(spark, d).filter("WBID <> 'R4'"), ("R0", "R1", "R2"), 2)


@query
def dq_without_region(spark, d):
    return checks.without_region_share(w.samples(spark, d), w.stations(spark, d))


@query
def dq_audit(spark, d):
    """All 17 checks; those of distinct values read one saved profile of the samples."""
    s, st, listed, regions = w.samples(spark, d), w.stations(spark, d), _listed(spark, d), w.regions(spark, d)
    p = saved(checks.sample_profile(s), "sample-profile")
    labels = checks.profile_labels(p)
    bottom = p.withColumn("location", F.when(F.col("location") == "bott", "bottom").otherwise(F.col("location")))
    return checks.audit({
        "physical stations": checks.unknown_physical_stations(p, listed),
        "discrete stations": checks.unknown_discrete_stations(p, listed),
        "continuous stations": dq_continuous_stations(spark, d),
        "time steps": dq_time_steps(spark, d),
        "counties": checks.county_mismatch(p, ("C0", "C1", "C2", "C9")),
        "sample dates": dq_dates(spark, d),
        "station box": checks.stations_outside_box(st, w.BOX),
        "station criteria": checks.stations_without_criteria(p, w.criteria(spark, d).filter("parameter = 'chl'")),
        "criteria regions": dq_criteria_regions(spark, d),
        "parameters": checks.parameters_without_entry(p, labels),
        "rain values": dq_rain_values(spark, d),
        "rain dates": dq_rain_dates(spark, d),
        "rain gauges": checks.unknown_gauges(w.rain_daily(spark, d).select("station").distinct(), w.gauges(spark, d).filter("WBID IS NOT NULL")),
        "gauge regions": dq_gauge_regions(spark, d),
        "sample locations": checks.bad_locations(bottom),
        "waterbodies": checks.waterbody_mismatch(p, ("NATION_0", "NATION_1", "NATION_99")),
        "station regions": checks.station_region_problems(st, regions.filter("WBID <> 'R4'"), ("R0", "R1", "R2"), 2),
    })


# --- continuous readings ---------------------------------------------------------------------------


@query
def cont_station_mean(spark, d):
    out = continuous.continuous_station_mean(w.readings(spark, d), w.stations(spark, d), "temp", "2024-01-02", "2024-01-25")
    return out.select("waterbody", "station", "variable", "val", "WATERBODY_NAME", "lon", "lat")


@query
def cont_gauge(spark, d):
    means = continuous.continuous_station_mean(w.readings(spark, d), w.stations(spark, d), "temp")
    return continuous.continuous_gauge(means, "Temperature (F)")


@query
def cont_day_trend(spark, d):
    out = queries.sensor_series(w.readings(spark, d), "temp", "day", show_trend=True)
    return out.select("waterbody", "station", "date", "val", "trend")


@query
def cont_cycle(spark, d):
    """The daily cycle of each sensor, its wave highest at four in the afternoon."""
    return continuous.daily_cycle(w.readings(spark, d), "temp")


def _cont(spark, d, period):
    return continuous.continuous_period(w.readings(spark, d), "temp", period)


@query
def cont_day(spark, d):
    return _cont(spark, d, "day")


@query
def cont_week(spark, d):
    return _cont(spark, d, "week")


@query
def cont_month(spark, d):
    return _cont(spark, d, "month")


@query
def cont_quarter(spark, d):
    return _cont(spark, d, "quarter")


@query
def cont_year(spark, d):
    return _cont(spark, d, "year")


@query
def cont_trend(spark, d):
    return continuous.continuous_trend(w.readings(spark, d), "sal").drop("variable")


@query
def rain_distribution(spark, d):
    return rain.rain_distribution(w.rain_daily(spark, d))


@query
def rain_outliers(spark, d):
    # the cube spreads the tail enough to leave outliers
    spread = w.rain_daily(spark, d).withColumn("precip_inches", F.pow("precip_inches", 3))
    return rain.rain_outliers(spread)


# --- grids and running figures ---------------------------------------------------------------------


@query
def station_grid(spark, d):
    return joins.station_grid(w.stations(spark, d), ("temp_f", "sal_ppt"))


@query
def running_totals(spark, d):
    """Cumulative rain per gauge over its days."""
    from tidemark.operators.ordered import running_sum

    daily = w.rain_daily(spark, d).groupBy("station", "date").agg(F.sum("precip_inches").alias("inches"))
    out = running_sum(daily.withColumn("year", F.year("date")), ["station"], "year", "date", "inches", "so_far")
    return out.select("station", "date", "inches", "so_far")


# --- streams ---------------------------------------------------------------------------------------


def _feed(spark, d):
    """Events as a file stream of wide sensor readings."""
    ev = jobs.read_feed(spark, w.feed_path(d, "events"), w.table(spark, d, "events").schema)
    n = w.table(spark, d, "supplier").count()
    return ev.withColumn("_k", F.col("user_id") % n).join(w._keys(spark, d), F.col("_k") == F.col("s_suppkey")).select(
        "waterbody", "station", F.col("ts").cast("timestamp").alias("timestamp"), "event_id",
        F.col("value").alias("temp_f"), (F.col("value") / F.lit(15.0)).alias("sal_ppt"),
    )


def _finished(q) -> None:
    q.awaitTermination()


def _arriving(spark, d, name, delay_minutes, job, copies=lambda k: F.array(F.lit(0)), parts=4) -> str:
    """Readings in order of arrival, in parts: each part is put into the feed, then the job runs till it is used up.

    The delay of a reading and the minutes after which copies of it arrive follow from its number.
    """
    out = scratch_dir(spark, name)
    sent = w.readings(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    sent = sent.withColumn("_after", F.explode(copies(F.col("event_id"))))
    sent = saved(sent.withColumn("arrival", F.unix_micros("timestamp") + (delay_minutes(F.col("event_id")) + F.col("_after")).cast("long") * 60_000_000), f"{name}-sent")
    lo, hi = sent.agg(F.min("arrival"), F.max("arrival")).first()
    part = F.expr(f"((arrival - {lo}) * {parts}) div {hi - lo + 1}")
    for i in range(parts):
        sent.filter(part == i).drop("_after").write.mode("append").parquet(f"{out}/feed")
        _finished(job(jobs.read_feed(spark, f"{out}/feed", sent.drop("_after").schema), out))
    return out


@query
def stream_dedupe(spark, d):
    out = scratch_dir(spark, "dedupe")
    # each reading arrives twice
    twice = jobs.sensor_readings(_feed(spark, d)).withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    _finished(jobs.append_to(jobs.deduplicated(twice), f"{out}/rows", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows").groupBy("waterbody", "station", "variable").agg(
        F.count("*").alias("n"), F.sum("val").alias("total")
    )


def _window_means(spark, d, name):
    out = scratch_dir(spark, name)
    long = jobs.sensor_readings(_feed(spark, d), ("temp_f",)).withWatermark("timestamp", "1 hour")
    return out, jobs.window_means(long)


@query
def stream_window_mean(spark, d):
    out, means = _window_means(spark, d, "windows")
    _finished(jobs.update_to(means, f"{out}/rows", f"{out}/checkpoint"))
    return jobs.latest(spark, f"{out}/rows", ["start", *jobs.SERIES])


@query
def stream_enriched(spark, d):
    out, means = _window_means(spark, d, "enriched")
    limits = w.criteria(spark, d).filter("parameter = 'tn'").withColumns({
        "parameter": F.lit("tem"), "value": F.col("value") * 1000
    })
    known = jobs.enriched(means, w.stations(spark, d).select("waterbody", "station", "WBID"), limits)
    _finished(jobs.update_to(known, f"{out}/rows", f"{out}/checkpoint"))
    rows = jobs.latest(spark, f"{out}/rows", ["start", *jobs.SERIES])
    return rows.select("start", "waterbody", "station", "n", "val", "WBID", "criterion", "above")


@query
def stream_dq(spark, d):
    out = scratch_dir(spark, "stream-dq")
    unknown = jobs.unknown_stations(jobs.sensor_readings(_feed(spark, d), ("temp_f",)), _listed(spark, d))
    _finished(jobs.append_to(unknown, f"{out}/rows", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows").groupBy("waterbody", "station").agg(F.count("*").alias("n"))


@query
def stream_steps(spark, d):
    """Arrivals numbered against the clock: every step but the first is backward."""
    out = scratch_dir(spark, "steps")
    feed = _feed(spark, d).withColumn("arrival", -F.col("event_id"))
    _finished(jobs.check_steps(feed, "arrival", out, f"{out}-checkpoint"))
    return jobs.step_violations(spark, out).groupBy("waterbody", "station").agg(F.count("*").alias("n"))


@query
def stream_gaps(spark, d):
    """Silences of six hours and more; readings arrive up to 49 minutes late, in four batches."""
    def job(feed, out):
        found = jobs.stretches(feed.withWatermark("timestamp", "1 hour"), "6 hours")
        return jobs.append_to(found, f"{out}/rows", f"{out}/checkpoint")

    out = _arriving(spark, d, "gaps", lambda k: k % 50, job)
    return jobs.gaps(spark.read.parquet(f"{out}/rows"))


@query
def stream_late(spark, d):
    """What becomes of every arriving reading: each seventh arrives twice, each tenth half a day late."""
    def job(feed, out):
        return jobs.sorted_out_to(jobs.sensor_readings(feed), f"{out}/sorted", f"{out}/checkpoint")

    again = lambda k: F.when(k % 7 == 0, F.array(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0)))
    out = _arriving(spark, d, "late", lambda k: F.when(k % 10 == 0, 720).otherwise(0), job, again)
    return jobs.sorted_out(spark, f"{out}/sorted").groupBy("waterbody", "station", "variable", "kind").agg(F.count("*").alias("n"))


@query
def stream_late_steps(spark, d):
    """Backward steps of more than an hour, in order of arrival; each third reading arrives half an hour late, each tenth half a day."""
    delay = lambda k: F.when(k % 10 == 0, 720).when(k % 3 == 0, 30).otherwise(0)
    out = _arriving(
        spark, d, "late-steps", delay,
        lambda feed, out: jobs.check_steps(feed, "arrival", f"{out}/steps", f"{out}/checkpoint", 86_400_000_000, "1 hour"),
    )
    return jobs.step_violations(spark, f"{out}/steps").select("waterbody", "station", "timestamp", "previous")


@query
def stream_snapshot(spark, d):
    """``stream_window_mean`` over four batches, folded after every second one."""
    keys = ["start", *jobs.SERIES]

    def job(feed, out):
        means = jobs.window_means(jobs.sensor_readings(feed, ("temp_f",)).withWatermark("timestamp", "1 hour"))
        return jobs.update_to(means, f"{out}/rows", f"{out}/checkpoint", keys, F.date_trunc("week", "start"), fold_every=2)

    out = _arriving(spark, d, "snapshot", lambda k: k % 50, job)
    return jobs.latest(spark, f"{out}/rows", keys)


@query
def stream_rain_month(spark, d):
    out = scratch_dir(spark, "rain")
    o = jobs.read_feed(spark, w.feed_path(d, "orders"), w.table(spark, d, "orders").schema)
    p = F.col("o_orderpriority")
    daily = o.select(
        F.concat(F.lit("G"), F.substring(p, 1, 1)).alias("station"), p.alias("name"), F.to_date("o_orderdate").alias("date"),
        (F.col("o_totalprice") / F.lit(100000.0)).alias("precip_inches"),
    )
    _finished(jobs.rain_months_to(daily, f"{out}/rows", f"{out}/checkpoint"))
    return jobs.rain_months(spark, f"{out}/rows")
