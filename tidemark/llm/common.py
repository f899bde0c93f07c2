"""Tables, shared scratch storage and bounded samples for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_dir

#: Word separators of every contract here: space and \x09-\x0D. bytes.split() uses exactly these.
WORD = r"[^ \t-\r]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write under the shared checkpoint folder and read back.

    Cuts lineage: after a lost executor, later jobs read the table instead of
    running everything before it again.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove saved tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            p = hadoop(folder)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def with_missing(df: DataFrame, *more, **types: str) -> DataFrame:
    """The named columns only, cast, and what more is asked for; columns that the table lacks are null."""
    return df.select(*more, *[(F.col(f"`{c}`").cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in types.items()])


def whole_row(df: DataFrame):
    """All columns as one struct, "row", so that no name of theirs meets one of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def crc_of_id(doc_id: str = "doc_id"):
    """crc32 of an id written as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
