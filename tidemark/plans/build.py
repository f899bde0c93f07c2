"""Builds of the saved tables, one job graph per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions.text import capitalise
from tidemark.operators import checks, clean, rain, reshape, spatial, summary
from tidemark.sources import polygons, rain_payloads, sheets, tables, versions


def build_samples(field: DataFrame, lab: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Raw field and laboratory sheets to the tidy sample table."""
    return reshape.tidy_samples(
        physical=reshape.field_long(clean.clean_field_sheet(field)),
        discrete=reshape.lab_long(clean.clean_lab_sheet(lab, exclusions)),
    )


def build_regions(polygons_: DataFrame, points: DataFrame) -> DataFrame:
    """The polygons in which points lie, their names capitalised."""
    hit = spatial.regions_with_points(polygons_, points)
    return hit.withColumn("WATERBODY_NAME", capitalise(F.col("WATERBODY_NAME")))


def build_stations(sheet: DataFrame, regions: DataFrame, samples: DataFrame) -> DataFrame:
    """The station list with region and date span."""
    located = spatial.resolve_multiple(spatial.locate(sheet, regions))
    return summary.with_span(located, samples).select(*[f.name for f in S.STATIONS.fields])


def build_gauges(spark: SparkSession, regions: DataFrame) -> DataFrame:
    """The rain gauges with name and region."""
    rows = [(s, S.RAIN_STATIONS[s], lon, lat) for s, lat, lon in S.RAIN_STATION_COORDS]
    gauges = spark.createDataFrame(rows, "station string, name string, lon double, lat double")
    return spatial.locate(gauges, regions).select(*[f.name for f in S.GAUGES.fields])


def build_rain(daily: DataFrame) -> DataFrame:
    return rain.rain_monthly(daily).select(*[f.name for f in S.RAIN.fields])


def build_criteria(wide: DataFrame) -> DataFrame:
    return reshape.criteria_long(clean.clean_criteria(wide)).select(*[f.name for f in S.CRITERIA.fields])


def build_all(spark: SparkSession, sources: dict[str, str], folder: str, lines: bool = False, found: dict[str, int] | None = None) -> dict[str, str]:
    """Read every source, write every table and return the paths.

    ``sources`` names the paths ``field``, ``lab``, ``exclusions``,
    ``stations``, ``polygons``, ``rain`` and ``criteria``. Later tables read
    earlier ones back from storage, so nothing is computed twice. With ``lines``
    polygons and rain payloads are one a line, otherwise one a file. Checks that
    look at one row at a time ride on the pass that writes a table; ``found`` takes
    their numbers of bad rows.
    """
    paths, metrics = {}, checks.row_metrics()

    def save(name: str, df: DataFrame) -> DataFrame:
        seen = Observation(name)
        if name in metrics:
            df = df.observe(seen, *[c.alias(check) for check, c in metrics[name].items()])
        paths[name] = tables.save_table(df, folder, name)
        if name in metrics and found is not None:
            found.update(seen.get)
        return tables.load_table(spark, folder, name)

    everywhere = polygons.read_geojson(spark, sources["polygons"], lines=lines)
    save("rain", build_rain(rain_payloads.read_rain_payloads(spark, sources["rain"], multi_line=not lines)))
    gauge_points = spark.createDataFrame(
        [(lon, lat) for _, lat, lon in S.RAIN_STATION_COORDS], "lon double, lat double"
    )
    rain_regions = save("rain_regions", build_regions(everywhere, gauge_points))
    save("gauges", build_gauges(spark, rain_regions))
    samples = save(
        "samples",
        build_samples(
            sheets.read_field_sheet(spark, sources["field"]),
            sheets.read_lab_sheet(spark, sources["lab"]),
            sheets.read_exclusions(spark, sources["exclusions"]),
        ),
    )
    station_sheet = sheets.read_station_sheet(spark, sources["stations"])
    regions = save("regions", build_regions(everywhere, station_sheet))
    save("stations", build_stations(station_sheet, regions, samples))
    save("catalogue", summary.catalogue(samples))
    save("criteria", build_criteria(sheets.read_criteria_sheet(spark, sources["criteria"])))
    return paths


def build_version(spark: SparkSession, sources: dict[str, str], folder: str, lines: bool = False, keep: int = 2) -> dict[str, str]:
    """``build_all`` as a new version of the folder: readers of ``versions.current`` see all its tables or none."""
    return versions.publish(spark, folder, lambda at: build_all(spark, sources, at, lines), keep)
