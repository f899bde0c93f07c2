"""Cleaning of the wide field and laboratory sheets, the station list and the criteria."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import dates, text, values
from tidemark.operators.joins import exclude


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*text.clean_names(df.columns))


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose whole name matches."""
    return df.drop(*[c for c in df.columns if re.fullmatch(pattern, c)])


def known_headings(found: list[str], expected: Iterable[str]) -> list[str]:
    """The measured columns as found; a heading no rename knows would lose its readings, so it fails."""
    unknown = sorted(set(found) - set(expected))
    if unknown:
        raise ValueError(f"unknown headings {unknown}")
    return found


def ids_first(df: DataFrame, ids: Iterable[str] = S.FIELD_IDS) -> DataFrame:
    ids = list(ids)
    return df.select(*ids, *[c for c in df.columns if c not in ids])


def clean_field_sheet(raw: DataFrame) -> DataFrame:
    """The field sheet with model names, typed columns and one spelling per county and waterbody."""
    df = clean_column_names(raw).withColumnsRenamed(S.FIELD_RENAMES).drop(*S.CALENDAR_COLUMNS)
    measured = known_headings([c for c in df.columns if c not in S.FIELD_IDS], S.FIELD_RENAMES.values())
    return df.select(
        values.recode(F.col("county"), S.COUNTY_RECODE).alias("county"),
        values.replace_in_order(F.col("waterbody"), S.WATERBODY_FIXES).alias("waterbody"),
        F.col("station").cast("string").alias("station"),
        dates.parse_mdy(F.col("date")).alias("date"),
        *[values.to_number(F.col(c)).alias(c) for c in measured],
    )


def clean_lab_sheet(raw: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """The laboratory sheet: remarks scrubbed, numbers parsed, units aligned, retired stations removed."""
    df = drop_matching(clean_column_names(raw), r"x\d+").withColumnsRenamed(S.LAB_RENAMES)
    measured = known_headings([c for c in df.columns if c not in S.LAB_IDS], (*S.LAB_RENAMES.values(), "secchi_ft"))
    typed = df.select(
        "county",
        values.replace_in_order(F.col("waterbody"), S.LAB_WATERBODY_FIXES).alias("waterbody"),
        "station",
        dates.parse_mdy(F.col("date")).alias("date"),
        "secchi_onbott",
        *[values.to_number(values.scrub(F.col(c))).alias(c) for c in measured],
    )
    # second step: the depth is read from the note before the note turns into a flag
    done = typed.withColumns(
        {
            "tp_mgl": values.thousandth(F.col("tp_mgl")),
            "tn_mgl": values.thousandth(F.col("tn_mgl")),
            "cond_mscm": values.conductivity(F.col("cond_mscm"), F.col("cond_uscm")),
            "secchi_ft": values.note_depth(F.col("secchi_ft"), F.col("secchi_onbott")),
            "secchi_onbott": values.on_bottom(F.col("secchi_onbott")),
        }
    ).drop("cond_uscm", *S.CALENDAR_COLUMNS)
    out = ids_first(done)
    return out if exclusions is None else exclude(out, exclusions)


def clean_criteria(wide: DataFrame) -> DataFrame:
    """Criteria with outdated region ids replaced."""
    return wide.withColumn("WBID", values.recode(F.col("WBID"), S.CRITERIA_REGION_RECODE))
