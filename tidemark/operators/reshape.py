"""Wide to long, long to wide, and unions by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import text, values
from tidemark.operators.filters import valid


def to_long(df: DataFrame, ids: Sequence[str] = S.FIELD_IDS) -> DataFrame:
    """All columns but the ids as (var, val) rows; missing values keep their row."""
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], "var", "val")


def split_variable(df: DataFrame, into: Sequence[str], column: str = "var") -> DataFrame:
    """Split ``a_b_c`` into named parts: a missing part is NULL, surplus parts are dropped."""
    return df.withColumns({n: text.name_part(F.col(column), i) for i, n in enumerate(into)}).drop(column)


def to_named_parts(df: DataFrame, into: Sequence[str], ids: Sequence[str] = S.FIELD_IDS) -> DataFrame:
    """``split_variable`` of ``to_long``: names are split once per column here, not once per row."""
    cells = []
    for c in [c for c in df.columns if c not in ids]:
        parts = c.split("_")
        cells += [F.col(c), *[F.lit(parts[i] if i < len(parts) else None).cast("string") for i in range(len(into))]]
    return df.select(*ids, F.stack(F.lit(len(cells) // (len(into) + 1)), *cells).alias("val", *into))


def field_long(clean: DataFrame) -> DataFrame:
    """Field readings in long form."""
    long = to_named_parts(clean, ("parameter", "location", "units"))
    return long.withColumn("notes", F.lit(None).cast("string"))


def lab_long(clean: DataFrame) -> DataFrame:
    """Laboratory results in long form, de-duplicated, the disc depth with its note.

    A note belongs to the very row its depth came from, so it rides along as an
    id column and the later look-up by six keys is not needed: one shuffle (the
    de-duplication) does the work of three.
    """
    ids = [*S.FIELD_IDS, "secchi_onbott"]
    long = to_named_parts(clean, ("parameter", "units"), ids)
    return long.select(
        *S.FIELD_IDS,
        "val",
        "parameter",
        "units",
        F.lit("surf").alias("location"),
        F.when(F.col("parameter") == "secchi", values.on_bottom_note(F.col("secchi_onbott"))).alias("notes"),
    ).distinct()


def secchi_notes(clean: DataFrame) -> DataFrame:
    """Distinct disc depths with their notes, keyed like the long form."""
    return clean.select(
        *S.FIELD_IDS,
        F.col("secchi_ft").alias("val"),
        values.on_bottom_note(F.col("secchi_onbott")).alias("notes"),
        F.lit("secchi").alias("parameter"),
    ).distinct()


def tagged_union(**sources: DataFrame) -> DataFrame:
    """Stack frames by column name under a ``type`` tag; an absent column is NULL."""
    frames = [df.withColumn("type", F.lit(tag)) for tag, df in sources.items()]
    return union_by_name(*frames)


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    out = first
    for o in others:
        out = out.unionByName(o, allowMissingColumns=True)
    return out


def tidy_samples(**sources: DataFrame) -> DataFrame:
    """The sample table: tagged union, valid values only, model column order."""
    return valid(tagged_union(**sources)).select(*[f.name for f in S.SAMPLES.fields])


def criteria_long(wide: DataFrame) -> DataFrame:
    """One row per station, region and criterion that exists."""
    long = wide.unpivot(
        ["waterbody", "station", "WBID"], list(S.CRITERIA_PARAMETERS), "parameter", "value"
    )
    return valid(long, "value")


def to_wide(df: DataFrame, ids: Sequence[str], names: str, values_from: str, kinds: Sequence[str]) -> DataFrame:
    """Series kinds to columns; the kinds are given, so no extra pass finds them."""
    return df.groupBy(*ids).pivot(names, list(kinds)).agg(F.first(values_from, ignorenulls=True))
