"""Continuous sensor and rain feeds as Structured Streaming jobs.

Counts, means and variances are kept incrementally by the stateful aggregate;
intervals are arithmetic on the aggregated row. Results that change over time
leave in update mode as one folder per micro-batch, written idempotently and
folded into a snapshot now and then; ``latest`` reads back the newest row per key.

Jobs run until the input is used up, or by the trigger given to them, such as
``processingTime="1 minute"``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.functions import dates
from tidemark.functions.student import t_bounds
from tidemark.functions.values import present
from tidemark.operators.criteria import with_criterion
from tidemark.operators import moments
from tidemark.operators.rain import monthly_totals
from tidemark.operators.joins import join_on, with_station_info
from tidemark.operators.ordered import newest_before, previous_value
from tidemark.sources import folders
from tidemark.streaming import snapshots

SERIES = ("waterbody", "station", "variable")


def read_feed(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A folder of arriving parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def sensor_readings(wide: DataFrame, variables: Sequence[str] = ("temp_f", "sal_ppt"), keep: Sequence[str] = ()) -> DataFrame:
    """Typed long readings: station as text, event time as a zoned timestamp, missing values dropped."""
    ids = ["waterbody", "station", "timestamp", *keep]
    typed = wide.select(
        F.col("waterbody").cast("string").alias("waterbody"),
        F.col("station").cast("string").alias("station"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        *keep,
        *[F.col(v).cast("double").alias(v) for v in variables],
    )
    long = typed.unpivot(ids, list(variables), "variable", "val")
    return long.filter(present(F.col("val")) & F.col("timestamp").isNotNull())


def deduplicated(readings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated (station, variable, time) readings; the watermark bounds the remembered keys."""
    marked = readings.withWatermark("timestamp", delay)
    return marked.dropDuplicatesWithinWatermark([*SERIES, "timestamp"])


def window_means(readings: DataFrame, width: str = "15 minutes") -> DataFrame:
    """Mean with interval per station, variable and tumbling window; needs a watermark."""
    grouped = readings.groupBy(F.window("timestamp", width).alias("w"), *SERIES).agg(
        F.count("val").alias("n"), F.avg("val").alias("val"), F.var_samp("val").alias("_var")
    )
    lo, hi = t_bounds("n", "val", "_var")
    return grouped.select(
        F.col("w.start").alias("start"), *SERIES, "n", "val", lo.alias("lovl"), hi.alias("hivl")
    )


def enriched(means: DataFrame, stations: DataFrame, criteria: DataFrame) -> DataFrame:
    """Add station columns and flag means above the station's criterion (NULL where it has none)."""
    known = with_station_info(means, stations)
    tagged = known.withColumn("parameter", F.split("variable", "_")[0])
    flagged = with_criterion(tagged, criteria, "station").drop("parameter")
    return flagged.withColumn("above", F.col("val") > F.col("criterion"))


def unknown_stations(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Readings from stations that are not listed."""
    return join_on(readings, stations.select("waterbody", "station"), ["waterbody", "station"], "left_anti")


def stretches(readings: DataFrame, silence: str = "1 hour") -> DataFrame:
    """Stretches of readings per station without a silence of the given length; needs a watermark.

    The state is one row per open stretch. A stretch leaves once the watermark has
    passed its last reading by the silence: that is the moment the station counts
    as silent. Readings late within the watermark lengthen or unite stretches.
    """
    by = F.session_window("timestamp", silence)
    grouped = readings.groupBy(by.alias("w"), "waterbody", "station")
    return grouped.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("*").alias("n")).drop("w")


def gaps(finished: DataFrame) -> DataFrame:
    """Silences between finished stretches: station, last reading before, first reading after, seconds."""
    keys = ("waterbody", "station")
    after = previous_value(finished, keys, F.date_trunc("month", "first"), "first", "last", "gap_start")
    seconds = (F.unix_micros("first") - F.unix_micros("gap_start")) / F.lit(1e6)
    return after.filter("gap_start IS NOT NULL").select(*keys, "gap_start", F.col("first").alias("gap_end"), seconds.alias("seconds"))


def _started(writer: DataStreamWriter, checkpoint: str, trigger: dict) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_to(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append finished rows as parquet, exactly once."""
    return _started(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint, trigger)


def update_to(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = (), period: Column | None = None, fold_every: int = 0, **trigger
) -> StreamingQuery:
    """Write each micro-batch's changed rows to its own folder; a repeated batch overwrites itself.

    With ``fold_every`` the folders of earlier batches are folded after so many
    batches: ``keys`` name a row, ``period`` says from them which part of the
    snapshot it belongs to.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if fold_every and batch_id and batch_id % fold_every == 0:
            snapshots.fold(batch.sparkSession, path, keys, period, below=batch_id)
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _started(stream.writeStream.outputMode("update").foreachBatch(write), checkpoint, trigger)


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of an ``update_to`` folder: its snapshot and the batches since."""
    return snapshots.newest_rows(spark, path, keys)


def sorted_out_to(
    readings: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", keys: Sequence[str] = (*SERIES, "timestamp"), **trigger
) -> StreamingQuery:
    """Every arriving reading under ``path/rows`` as kept, repeated or late (column ``kind``), so that none is lost unseen.

    Late is what lies further than ``delay`` before the newest reading of earlier
    batches; repeated what has the keys of a kept one. The keys remembered are those
    within the delay. Each batch reads the state of the one before and writes rows
    and state to folders of its own number: a repeated batch overwrites itself.
    """

    reach = F.expr(f"INTERVAL {delay}")

    def newest_of(rows: DataFrame) -> Column:
        return F.timestamp_micros(F.lit(rows.agg(F.max(F.unix_micros("_at"))).first()[0]).cast("long"))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, f"{path}/seen"
        before = spark.read.schema(state).parquet(f"{seen}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], state)
        late = F.coalesce(F.col("timestamp") < newest_of(before) - reach, F.lit(False))
        rows = batch.withColumn("_late", late)
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_late").orderBy(F.lit(0))))
        rows = join_on(rows, before.select(*keys, F.lit(True).alias("_known")), keys, "left")
        kind = F.when(F.col("_late"), "late").when(F.col("_known") | (F.col("_nth") > 1), "repeated").otherwise("kept")
        out = rows.withColumn("kind", kind).drop("_late", "_nth", "_known")
        out.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/rows/batch={batch_id}")
        written = spark.read.schema(out.schema).parquet(f"{path}/rows/batch={batch_id}")
        held = written.filter("kind = 'kept'").select(*keys, F.col("timestamp").alias("_at")).unionByName(before)
        # the newest reading lies within the delay itself, so the clock stays with the keys
        held.filter(F.col("_at") >= newest_of(held) - reach).write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")
        folders.remove(spark, f"{seen}/batch={batch_id - 2}")

    state = T.StructType([*[readings.schema[k] for k in keys], T.StructField("_at", T.TimestampType())])
    return _started(readings.writeStream.outputMode("append").foreachBatch(step), checkpoint, trigger)


def sorted_out(spark: SparkSession, path: str) -> DataFrame:
    """All rows of ``sorted_out_to`` with their kind."""
    return spark.read.parquet(f"{path}/rows").drop("batch")


def _replace_months(df: DataFrame, path: str) -> None:
    """Overwrite the months that df holds and no others."""
    df.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def _parts_of_months(sums: DataFrame, path: str, batch_id: int) -> tuple[DataFrame, list[str]]:
    """Put a batch's sums under ``path/parts`` by month and batch; the parts of its months from all batches, and the months."""
    sums = sums.withColumn("batch", F.lit(batch_id).cast("long"))
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(f"{path}/parts")
    parts = sums.sparkSession.read.schema(sums.schema).parquet(f"{path}/parts")
    months = [r["month"] for r in parts.filter(F.col("batch") == batch_id).select("month").distinct().collect()]
    return parts.filter(F.col("month").isin(months)), months


def rain_months_to(daily: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Monthly totals per gauge; a batch rewrites the months its days fall into and no others.

    Each batch leaves its own sums under ``path/parts`` by month and batch; the
    totals of its months are then summed from the parts of those months alone and
    replace them under ``path/months``. A repeated batch replaces its parts, so the
    totals stay the same. Days may arrive at any time; there is no state to keep.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parts, months = _parts_of_months(monthly_totals(batch).withColumn("month", moments.month_of(F.col("date"))), path, batch_id)
        if months:
            _replace_months(parts.groupBy("station", "name", "date", "month").agg(F.sum("precip_inches").alias("precip_inches")), f"{path}/months")

    return _started(daily.writeStream.outputMode("append").foreachBatch(write), checkpoint, trigger)


def rain_months(spark: SparkSession, path: str) -> DataFrame:
    """The totals that ``rain_months_to`` keeps."""
    return spark.read.parquet(f"{path}/months").select("station", "name", "date", "precip_inches")


def check_steps(
    stream: DataFrame, order: str, path: str, checkpoint: str, chunk_rows: int = 100_000, tolerance: str | None = None, **trigger
) -> StreamingQuery:
    """Record every reading that is not later than the one before it, across micro-batches.

    With a ``tolerance`` a reading counts only if it also lies further than that
    before the newest one so far, so what is merely late within a watermark is no
    backward step. Each batch is checked together with the last reading per station
    of the batch before. Violations and last readings go to folders named by batch,
    so a repeated batch overwrites its own output; older last readings are removed.
    """
    keys = ("waterbody", "station")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, order, "timestamp", F.lit(None).cast("timestamp").alias("newest"))
        if batch_id > 0:
            rows = spark.read.schema(rows.schema).parquet(f"{path}/last/batch={batch_id - 1}").unionByName(rows)
        chunk = F.floor(F.col(order) / F.lit(chunk_rows))
        stepped = previous_value(rows, keys, chunk, order, "timestamp", "previous")
        bad = stepped.filter(F.col("timestamp") <= F.col("previous"))
        rows = rows.withColumn("newest", F.greatest("timestamp", "newest"))
        if tolerance is not None:
            far = newest_before(rows, keys, chunk, order, "newest", "_newest").filter(F.col("timestamp") < F.col("_newest") - F.expr(f"INTERVAL {tolerance}"))
            bad = join_on(bad, far.select(*keys, order), [*keys, order], "left_semi")
        bad.select(*keys, order, "previous", "timestamp").write.mode("overwrite").parquet(
            f"{path}/violations/batch={batch_id}"
        )
        lasts = rows.groupBy(*keys).agg(F.max(order).alias(order), F.max_by("timestamp", order).alias("timestamp"), F.max("newest").alias("newest"))
        lasts.write.mode("overwrite").parquet(f"{path}/last/batch={batch_id}")
        folders.remove(spark, f"{path}/last/batch={batch_id - 2}")

    return _started(stream.writeStream.outputMode("append").foreachBatch(step), checkpoint, trigger)


def step_violations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/violations").drop("batch")


def moments_to(readings: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = SERIES, **trigger) -> StreamingQuery:
    """Daily means under ``path/daily`` and their regression moments under ``path/moments``, by month.

    A batch leaves its sums per series and day under ``path/parts``; the days and
    moments of the months it falls into are put together from the parts of those
    months and replace them. A repeated batch replaces its parts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(*keys, F.to_date("timestamp").alias("date")).agg(F.sum("val").alias("total"), F.count("val").alias("n"))
        parts, months = _parts_of_months(sums.withColumn("month", moments.month_of(F.col("date"))), path, batch_id)
        if not months:
            return
        days = parts.groupBy(*keys, "date", "month").agg((F.sum("total") / F.sum("n")).alias("val"), F.sum("n").alias("n"))
        _replace_months(days, f"{path}/daily")
        kept = batch.sparkSession.read.schema(days.schema).parquet(f"{path}/daily").filter(F.col("month").isin(months))
        _replace_months(moments.month_moments(kept, keys), f"{path}/moments")

    return _started(readings.writeStream.outputMode("append").foreachBatch(write), checkpoint, trigger)


def refit_touched(
    spark: SparkSession, path: str, changed: DataFrame, keys: Sequence[str] = SERIES, method: str = "complete", years_back: int = 9, other_span: DataFrame | None = None
) -> DataFrame:
    """Lines of the series that received data, off the tables that ``moments_to`` keeps.

    Meant for ``foreachBatch``: ``changed`` is the batch. Whole months come from
    their moments; days are read only of months that the range cuts.
    """
    touched = changed.select(*keys).distinct()
    held = join_on(spark.read.parquet(f"{path}/moments"), touched, keys, "left_semi")
    return moments.fits(held, spark.read.parquet(f"{path}/daily"), keys, method, years_back, other_span)
