"""CSV export: strings quoted, numbers bare, missing values printed NA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTED = (T.StringType, T.CharType, T.VarcharType)


def _cell(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, _QUOTED):
        text = F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        # whole numbers without a trailing .0, none with an exponent that 15 decimals can do without
        written = c.cast("string")
        long_form = F.regexp_replace(c.try_cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
        text = F.when(written.contains("E"), F.coalesce(long_form, written)).otherwise(F.regexp_replace(written, r"\.0$", ""))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NA"))


def export_lines(df: DataFrame) -> DataFrame:
    """One text line per row, ready to write."""
    return df.select(F.concat_ws(",", *[_cell(f) for f in df.schema.fields]).alias("value"))


def export_header(df: DataFrame) -> str:
    return ",".join(f'"{n}"' for n in df.columns)


def write_export(df: DataFrame, path: str) -> None:
    """Write CSV part files, each starting with the header row.

    The line is a single column written by the CSV writer with quoting switched
    off, because the shape (strings quoted, numbers and NA bare) is not one the
    writer's own options can produce.
    """
    # the writer never quotes: an unused control character stands in for the quote
    lines = export_lines(df).toDF(export_header(df))
    (
        lines.write.mode("overwrite")
        .option("header", True)
        .option("quote", "\u0000")
        .option("sep", "\u0001")
        .option("escapeQuotes", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
