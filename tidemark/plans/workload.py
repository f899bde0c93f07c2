"""The monitoring tables as views over the generic star-schema test tables.

Suppliers are stations, order lines are field readings, events are laboratory
results and sensor readings, orders are daily rain. Every view covers its whole
input; the remainders below only spread missing values and remarks over it.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions.text import build_key
from tidemark.operators import rain as rain_ops
from tidemark.operators.reshape import union_by_name
from tidemark.sources.polygons import with_box

PARAMETERS = {  # parameter: (units, order-line expression)
    "temp": ("f", "l_quantity"),
    "tp": ("mgl", "l_extendedprice / 1000D"),
    "tn": ("mgl", "l_discount"),
    "chlcorr": ("ugl", "l_tax"),
}
EVENTS = ("click", "error", "purchase", "signup", "view")

# five rings over the station box: slanted, one with a hole, two overlapping
POLYGONS = (
    ("P1", "UPPER WEST BAY", [[(-86.85, 30.25), (-86.50, 30.28), (-86.42, 30.75), (-86.80, 30.70)]]),
    ("P2", "LOWER WEST BAY", [[(-86.60, 30.55), (-86.20, 30.50), (-86.15, 30.95), (-86.55, 31.00)]]),
    ("P3", "HOLED LAKE", [
        [(-86.25, 30.25), (-85.75, 30.30), (-85.80, 30.85), (-86.20, 30.80)],
        [(-86.10, 30.45), (-85.92, 30.47), (-85.95, 30.65), (-86.08, 30.62)],
    ]),
    ("P4", "NORTH RIVER", [[(-86.85, 30.80), (-86.60, 31.05), (-86.20, 31.12), (-86.82, 31.15)]]),
    ("P5", "EAST MIDDLE/LOWER CREEK", [[(-86.10, 30.90), (-85.78, 30.88), (-85.70, 31.15), (-86.05, 31.12)]]),
)
BOX = {"xmin": -86.55, "ymin": 30.45, "xmax": -86.05, "ymax": 30.95}


# declared, so that opening a table costs no job to look at file footers
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(os.path.join(folder, f"{name}.parquet"))


def feed_path(folder: str, name: str) -> str:
    """A stream source path that fits a single file as well as a folder of files.

    As a pattern it is listed, not taken for a folder; it matches this one name only.
    """
    return os.path.join(folder, f"{name}.[p]arquet")


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with the names of their nation and region.

    The 25 nations come as one map value (a scalar subquery), not as a join.
    What is left is a projection of one table, whose size Catalyst knows: it is
    broadcast while it is small and shuffled once it is not, without a hint.
    """
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    named = n.join(r, n.n_regionkey == r.r_regionkey)
    nations = named.select(
        F.map_from_entries(F.collect_list(F.struct("n_nationkey", F.struct("n_nationkey", "n_name", "n_regionkey", "r_name"))))
    ).scalar()
    at = table(spark, folder, "supplier").select("s_suppkey", "s_name", nations[F.col("s_nationkey")].alias("n"))
    no_region = F.col("n.n_nationkey").isin(7, 19)
    return at.filter("n IS NOT NULL").select(
        "s_suppkey",
        "n.n_nationkey",
        "n.n_regionkey",
        F.concat(F.lit("C"), (F.col("n.n_nationkey") % 5).cast("string")).alias("county"),
        F.col("n.n_name").alias("waterbody"),
        F.col("s_suppkey").cast("string").alias("station"),
        F.col("s_name").alias("name"),
        F.when(~no_region, F.concat(F.lit("R"), F.col("n.n_regionkey").cast("string"))).alias("WBID"),
        F.when(~no_region, F.col("n.r_name")).alias("WATERBODY_NAME"),
        (F.lit(-86.8) + F.lit(0.01) * (F.col("s_suppkey") % 100)).alias("lon"),
        (F.lit(30.30) + F.lit(0.01) * ((F.col("s_suppkey") * 7) % 80)).alias("lat"),
    )


def stations(spark: SparkSession, folder: str) -> DataFrame:
    return _places(spark, folder).select("waterbody", "station", "name", "WBID", "WATERBODY_NAME", "lon", "lat")


def regions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("WBID"),
        F.col("r_name").alias("WATERBODY_NAME"),
    )


def _keys(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    return _places(spark, folder).select("s_suppkey", "county", "waterbody", "station", *extra)


def _missing() -> F.Column:
    return F.col("l_orderkey") % 50 == 0


def physical(spark: SparkSession, folder: str, parameters: Sequence[str] = tuple(PARAMETERS)) -> DataFrame:
    """Field readings; only the columns of the wanted parameters are read."""
    line = table(spark, folder, "lineitem")
    wide = line.select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_linestatus") == "O", "surf").otherwise("bott").alias("location"),
        *[F.when(~_missing(), F.expr(PARAMETERS[p][1])).alias(p) for p in parameters],
    )
    long = wide.unpivot(["l_suppkey", "date", "location"], list(parameters), "parameter", "val")
    units = F.create_map(*[F.lit(x) for p in parameters for x in (p, PARAMETERS[p][0])])
    return long.join(_keys(spark, folder), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.lit("physical").alias("type"), "county", "waterbody", "station", "date", "parameter", "location",
        units[F.col("parameter")].alias("units"), "val", F.lit(None).cast("string").alias("notes"),
    )


def _events(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    n = table(spark, folder, "supplier").select(F.count("*")).scalar()
    ev = table(spark, folder, "events").withColumn("_k", F.col("user_id") % n)
    return ev.join(_keys(spark, folder, *extra), F.col("_k") == F.col("s_suppkey"))


def discrete(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select(
        F.lit("discrete").alias("type"), "county", "waterbody", "station", F.to_date("ts").alias("date"),
        F.col("event_type").alias("parameter"), F.lit("surf").alias("location"), F.lit("ct").alias("units"),
        F.col("value").alias("val"), F.when(F.col("event_id") % 10 == 0, S.ON_BOTTOM_NOTE).alias("notes"),
    )


def samples(spark: SparkSession, folder: str, parameters: Sequence[str] | None = None) -> DataFrame:
    """All readings, or those of the listed parameters (which prunes sources and columns)."""
    wanted = (*PARAMETERS, *EVENTS) if parameters is None else tuple(parameters)
    field = [p for p in wanted if p in PARAMETERS]
    lab = [p for p in wanted if p in EVENTS]
    parts = []
    if field:
        parts.append(physical(spark, folder, field))
    if lab:
        d = discrete(spark, folder)
        parts.append(d if set(lab) == set(EVENTS) else d.filter(F.col("parameter").isin(*lab)))
    return union_by_name(*parts)


def rain_daily(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("G"), F.substring(p, 1, 1)).alias("station"),
        p.alias("name"),
        F.to_date("o_orderdate").alias("date"),
        (F.col("o_totalprice") / F.lit(100000.0)).alias("precip_inches"),
    )


def rain_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Daily rain with missing values of both kinds and missing dates."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    value = F.when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / F.lit(100000.0))
    return table(spark, folder, "orders").select(
        F.concat(F.lit("G"), F.substring(p, 1, 1)).alias("station"), p.alias("name"),
        F.when(k % 17 != 0, F.to_date("o_orderdate")).alias("date"), F.when(k % 11 != 0, value).alias("precip_inches"),
    )


DATE_SPELLINGS = (
    "M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "M.d.yyyy", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "M/d/yy", "M-d-yy", "M.d.yy",
)


def spelled_dates(spark: SparkSession, folder: str) -> DataFrame:
    """A day per part, written in every spelling in turn, some in small letters, and some that is no date."""
    k = F.col("p_partkey")
    at = F.date_add(F.to_date(F.lit("1999-01-01")), (k % 20000).cast("int"))
    text = F.lit("soon")
    for i, pattern in enumerate(DATE_SPELLINGS):
        written = F.date_format(at, pattern)
        text = F.when(k % 14 == i, F.when(k % 3 == 0, F.lower(written)).otherwise(written)).otherwise(text)
    return table(spark, folder, "part").select(k.alias("key"), F.when(k % 14 != 13, text).alias("day"))


def rain_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return rain_ops.monthly_totals(rain_daily(spark, folder))


def gauges(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("o_orderpriority")
    names = table(spark, folder, "orders").select(p).distinct()
    digit = F.substring(p, 1, 1).cast("int") - 1
    known = F.when(digit < 4, F.concat(F.lit("R"), digit.cast("string")))
    r = regions(spark, folder).withColumnRenamed("WBID", "_id")
    return (
        names.select(F.concat(F.lit("G"), F.substring(p, 1, 1)).alias("station"), p.alias("name"), known.alias("WBID"))
        .join(r, F.col("WBID") == F.col("_id"), "left")
        .drop("_id")
    )


def criteria_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Criteria per station: phosphorus by region, nitrogen by station, chlorophyll by waterbody."""

    def value(key: str):
        return F.lit(0.02) * (F.lit(1) + F.col(key) % 3)

    return _places(spark, folder).select(
        "waterbody", "station", "WBID", value("n_regionkey").alias("tp"), value("s_suppkey").alias("tn"),
        F.when(F.col("n_regionkey") != 4, value("n_nationkey")).alias("chl"),
    )


def criteria(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators.reshape import criteria_long

    return criteria_long(criteria_wide(spark, folder))


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Sensor readings, wide, with their number of arrival."""
    return _events(spark, folder).select(
        "waterbody", "station", F.col("ts").alias("timestamp"), "event_id",
        F.col("value").alias("temp_f"), (F.col("value") / F.lit(15.0)).alias("sal_ppt"),
    )


def polygons(spark: SparkSession) -> DataFrame:
    rows = [
        (i, n, [[{"x": x, "y": y} for x, y in [*ring, ring[0]]] for ring in rings]) for i, n, rings in POLYGONS
    ]
    fields = [f for f in S.REGIONS.fields if f.name in ("WBID", "WATERBODY_NAME", "rings")]
    from pyspark.sql.types import StructType

    return with_box(spark.createDataFrame(rows, StructType(fields)))


def raw_field(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines in the shape of the raw field sheet: original headings, everything text."""
    line = table(spark, folder, "lineitem").join(
        _keys(spark, folder), F.col("l_suppkey") == F.col("s_suppkey")
    )
    surf = F.col("l_linestatus") == "O"

    def cell(expr: str, at):
        return F.when(~_missing() & at, F.expr(expr).cast("string"))

    return line.select(
        F.when(F.col("county") == "C1", "okaloosa").when(F.col("county") == "C2", "walton")
        .otherwise(F.col("county")).alias("County"),
        F.concat(F.lit("Redfish creek "), F.col("waterbody")).alias("Water Body"),
        F.col("station").alias("Station Number"),
        F.date_format("l_shipdate", "M/d/yyyy").alias("Date (Month/Day/Year)"),
        F.month("l_shipdate").cast("string").alias("Month"),
        F.dayofmonth("l_shipdate").cast("string").alias("Day"),
        F.year("l_shipdate").cast("string").alias("Year"),
        F.lit("1200").alias("Time (24hr)"),
        cell("l_quantity", surf).alias("Temperature Surface (F)"),
        cell("l_quantity", ~surf).alias("Temperature Bottom (F)"),
        cell("l_discount", surf).alias("Salinity Surface (ppt)"),
        cell("l_discount", ~surf).alias("Salinity Bottom (ppt)"),
        cell("l_tax", surf).alias("pH Surface"),
    )


def raw_lab(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the shape of the raw laboratory sheet, remarks and unit slips included."""
    k = F.col("event_id")
    v = F.col("value").cast("string")
    note = (
        F.when(k % 5 == 0, F.concat(F.lit("Bottom ("), v, F.lit(")")))
        .when(k % 5 == 1, "Weeds").when(k % 5 == 2, "S").when(k % 5 == 3, "Not Reported")
    )
    return _events(spark, folder).select(
        F.col("county").alias("County"),
        F.concat(F.lit("GAP "), F.col("waterbody")).alias("Lake"),
        F.date_format("ts", "M/d/yyyy").alias("Date"),
        F.month("ts").cast("string").alias("Month"),
        F.dayofmonth("ts").cast("string").alias("Day"),
        F.year("ts").cast("string").alias("Year"),
        F.col("station").alias("Station"),
        dirty_number(k, v).alias("TP (µg/L)"),
        v.alias("TN (µg/L)"),
        F.when(k % 3 == 0, v).alias("Secchi (ft)"),
        note.alias("Secchi 2"),
        v.alias("Cond (µS/cm)"),
        F.when(k % 4 == 0, "0.5").alias("Cond (mS/cm)"),
        F.lit(None).cast("string").alias("1"),
    )


#: Headings of all measured columns of the field sheet: parameter, location and units after cleaning.
FIELD_COLUMNS = {
    "Temperature Surface (F)": "temp_surf_f", "Temperature Bottom (F)": "temp_bott_f",
    "Dissolved Oxygen (%) Surface (% Sat)": "dosat_surf_psat", "Dissolved Oxygen (%) Bottom (% Sat)": "dosat_bott_psat",
    "Dissolved Oxygen Surface (mg/L)": "do_surf_mgl", "Dissolved Oxygen Bottom (mg/L)": "do_bott_mgl",
    "Specific Conductivity (mS/cm) Surface": "cond_surf_mscm", "Specific Conductivity (mS/cm) Bottom": "cond_bott_mscm",
    "Salinity Surface (ppt)": "sal_surf_ppt", "Salinity Bottom (ppt)": "sal_bott_ppt", "pH Surface": "ph_surf_su", "pH Bottom": "ph_bott_su",
    "Turbidity Surface (NTU)": "turb_surf_ntu", "Turbidity Bottom (NTU)": "turb_bott_ntu", "Depth Surface (ft)": "depth_surf_ft", "Depth Bottom (ft)": "depth_bott_ft",
}


def _mixed_date(k, at):
    """A date in one of four spellings."""
    spelled = ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d")
    out = F.date_format(at, "MMMM d, yyyy")
    for i, pattern in enumerate(spelled):
        out = F.when(k % 4 == i, F.date_format(at, pattern)).otherwise(out)
    return out


def full_field(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as the whole field sheet: all 16 measured columns, dates in four spellings, some missing."""
    line = table(spark, folder, "lineitem").join(_keys(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
    k = F.col("l_orderkey") + F.col("l_linenumber")
    cells = [F.when((k + i) % 9 != 0, (F.col("l_quantity") + i).cast("string")).alias(h) for i, h in enumerate(FIELD_COLUMNS)]
    return line.select(
        F.col("county").alias("County"), F.concat(F.lit("Redfish creek "), F.col("waterbody")).alias("Water Body"),
        F.col("station").alias("Station Number"), F.when(k % 31 != 0, _mixed_date(k, F.col("l_shipdate"))).alias("Date (Month/Day/Year)"),
        F.month("l_shipdate").cast("string").alias("Month"), F.dayofmonth("l_shipdate").cast("string").alias("Day"),
        F.year("l_shipdate").cast("string").alias("Year"), F.lit("1200").alias("Time (24hr)"), *cells,
    )


def full_lab(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the whole laboratory sheet: all 8 measured columns, remarks with commas and quotes, dates in four spellings."""
    k, v = F.col("event_id"), F.col("value").cast("string")
    note = (
        F.when(k % 5 == 0, F.concat(F.lit('Bottom, "soft" ('), v, F.lit(")")))
        .when(k % 5 == 1, 'Weeds, "dense"').when(k % 5 == 2, "S").when(k % 5 == 3, "Not Reported")
    )
    return _events(spark, folder).select(
        F.col("county").alias("County"), F.concat(F.lit("GAP "), F.col("waterbody")).alias("Lake"), F.when(k % 31 != 0, _mixed_date(k, F.col("ts"))).alias("Date"),
        F.month("ts").cast("string").alias("Month"), F.dayofmonth("ts").cast("string").alias("Day"), F.year("ts").cast("string").alias("Year"),
        F.col("station").alias("Station"), dirty_number(k, v).alias("TP (µg/L)"), v.alias("TN (µg/L)"),
        dirty_number(k + 1, (F.col("value") + 1).cast("string")).alias("CHL (µg/L) uncorrected"), (F.col("value") + 2).cast("string").alias("CHL (µg/L) corrected"),
        F.when(k % 3 == 0, v).alias("Secchi (ft)"), note.alias("Secchi 2"), (F.col("value") + 3).cast("string").alias("Color (Pt-Co units)"),
        v.alias("Cond (µS/cm)"), F.when(k % 4 == 0, "0.5").alias("Cond (mS/cm)"), F.lit(None).cast("string").alias("1"),
    )


def dirty_number(k, v):
    """Numeric text with the sheets' junk spread over it."""
    r = k % 7
    return (
        F.when(r == 0, F.concat(v, F.lit("broken")))
        .when(r == 1, F.concat(F.lit("_"), v))
        .when(r == 2, ".")
        .when(r == 3, "")
        .when(r == 4, "Not Reported")
        .otherwise(v)
    )


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as untidy rows: junk in numbers, remarks for depths, odd spellings, text dates."""
    k = F.col("p_partkey")
    v = F.col("p_retailprice").cast("string")
    note = (
        F.when(k % 5 == 0, F.concat(F.lit("Bottom ("), F.col("p_size").cast("string"), F.lit(".5)")))
        .when(k % 5 == 1, "Weeds").when(k % 5 == 2, "S").when(k % 5 == 3, "Not Reported")
    )
    spelling = F.array(*[F.lit(x) for x in ("Swift creek", "FT. walton beach", "GAP Redfish", "Bass Lake", "Tky Bass Lake")])
    return table(spark, folder, "part").select(
        k.alias("key"),
        dirty_number(k, v).alias("number"),
        note.alias("note"),
        F.when(k % 4 == 0, F.col("p_size").cast("double")).alias("depth"),
        F.element_at(spelling, (k % 5 + 1).cast("int")).alias("waterbody"),
        F.element_at(F.array(F.lit("okaloosa"), F.lit("walton"), F.lit("Bay")), (k % 3 + 1).cast("int")).alias("county"),
        F.element_at(F.array(F.lit("959F"), F.lit("46"), F.lit("570")), (k % 3 + 1).cast("int")).alias("WBID"),
        F.concat_ws(" ", F.upper("p_type"), F.lower("p_name"), F.lit("(upper/lower)")).alias("title"),
        F.concat((k % 14).cast("string"), F.lit("/"), (k % 28 + 1).cast("string"), F.lit("/2001")).alias("day"),
        F.when(k % 2 == 0, F.col("p_retailprice") / 1000).alias("ms"),
        F.col("p_retailprice").alias("us"),
    )


def station_keys(df: DataFrame) -> DataFrame:
    return df.select(build_key(F.col("waterbody"), F.col("station")).alias("key"))
