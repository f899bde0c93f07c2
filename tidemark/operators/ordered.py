"""Ordered work on series of any length.

An ordered window over a series puts the whole series into one task. Where a
series can hold an unbounded share of the rows, these helpers cut it into
chunks first: the window runs inside each chunk, and a second window over one
summary row per chunk carries the state across chunk borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import join_on
from tidemark.session import saved


def _chunk_key(keys: Sequence[str], chunk: str) -> Column:
    """Series and chunk as one value. A struct is equal to itself with NULL fields, so a plain equality
    joins it, and that join reuses the partitioning and order the window inside the chunk has made."""
    return F.struct(*keys, chunk)


def running_sum(df: DataFrame, keys: Sequence[str], chunk: str, order: str, value: str, out: str) -> DataFrame:
    """Cumulative sum of ``value`` per series in ``order``; ``chunk`` must not decrease along it."""
    keyed = df.withColumn("_key", _chunk_key(keys, chunk))
    totals = keyed.groupBy("_key").agg(F.sum(value).alias("_total"))
    series = F.struct(*[F.col(f"_key.{k}") for k in keys])
    before = Window.partitionBy(series).orderBy(f"_key.{chunk}").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_key", F.coalesce(F.sum("_total").over(before), F.lit(0.0)).alias("_offset"))
    inside = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = keyed.withColumn("_inside", F.sum(value).over(inside))
    joined = rows.join(offsets, "_key")
    return joined.withColumn(out, F.col("_inside") + F.col("_offset")).drop("_key", "_inside", "_offset")


def previous_value(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: str, value: str, out: str
) -> DataFrame:
    """The value one row earlier in the series, NULL for its first row.

    ``chunk`` must not decrease along ``order``, which must be unique per series.
    """
    keyed = df.withColumn("_chunk", chunk).withColumn("_key", _chunk_key(keys, "_chunk")).drop("_chunk")
    lasts = keyed.groupBy("_key").agg(F.max_by(value, order).alias("_last"))
    series = F.struct(*[F.col(f"_key.{k}") for k in keys])
    across = Window.partitionBy(series).orderBy("_key._chunk")
    carried = lasts.select("_key", F.lag("_last").over(across).alias("_carried"))
    inside = Window.partitionBy("_key").orderBy(order)
    local = keyed.withColumns({"_lag": F.lag(value).over(inside), "_rn": F.row_number().over(inside)})
    joined = local.join(carried, "_key")
    first = F.col("_rn") == 1
    return joined.withColumn(out, F.when(first, F.col("_carried")).otherwise(F.col("_lag"))).drop(
        "_key", "_lag", "_rn", "_carried"
    )


def newest_before(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: str, value: str, out: str
) -> DataFrame:
    """The greatest value of all earlier rows of the series, NULL for its first row; as ``previous_value`` otherwise."""
    keyed = df.withColumn("_chunk", chunk).withColumn("_key", _chunk_key(keys, "_chunk")).drop("_chunk")
    tops = keyed.groupBy("_key").agg(F.max(value).alias("_top"))
    series = F.struct(*[F.col(f"_key.{k}") for k in keys])
    across = Window.partitionBy(series).orderBy("_key._chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("_key", F.max("_top").over(across).alias("_carried"))
    inside = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.withColumn("_inside", F.max(value).over(inside)).join(carried, "_key")
    return joined.withColumn(out, F.greatest("_inside", "_carried")).drop("_key", "_inside", "_carried")


#: Bits of a digit of the radix selection, and rows of a bin that are ordered as they are: no more than a digit has values.
DIGIT, FEW = 16, 1 << 16
_FRACTION = 1 << 52


def order_image(v: Column) -> Column:
    """The bits of a double as a whole number in the order of the doubles; NULL for NaN. Both zeros are 0, a negative is minus its opposite."""
    a = F.abs(v)
    scaled = lambda e: a * F.pow(F.lit(2.0), -e)
    guess = F.greatest(F.floor(F.log2(a)), F.lit(-1022))  # the logarithm may be off by one next to a power of two
    e = F.when(scaled(guess) >= 2, guess + 1).when((scaled(guess) < 1) & (guess > -1022), guess - 1).otherwise(guess)
    bits = F.when(a == float("inf"), F.lit(2047 * _FRACTION)).otherwise((e + 1022) * F.lit(_FRACTION) + (scaled(e) * F.lit(float(_FRACTION))).cast("long"))
    return F.when(v > 0, bits).when(v < 0, -bits).when(v == 0, F.lit(0).cast("long"))


def double_of_image(image: Column) -> Column:
    """The double of an ``order_image``."""
    m = F.abs(image)
    k, f = F.shiftright(m, 52), m % F.lit(_FRACTION)
    whole = ((f + F.lit(_FRACTION)).cast("double") / F.lit(float(_FRACTION))) * F.pow(F.lit(2.0), k - 1023)
    size = F.when(k == 0, f.cast("double") * F.lit(5e-324)).when(k == 2047, F.lit(float("inf"))).otherwise(whole)
    return F.when(image < 0, -size).otherwise(size)


def _bins_of_ranks(images: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> tuple[DataFrame, int]:
    """The bins of images that hold the wanted ranks, and how many low bits of an image a bin leaves open.

    A digit per round: the rows of the bins still wanted are counted by their next
    digit, which combines before the shuffle, so a window holds one row per value of
    a digit. Rounds end when no wanted bin has more than FEW rows, at the latest
    when every bin is one image.
    """
    bits, target = 64, None
    while True:
        bits -= DIGIT
        digit = F.shiftright("_image", bits)
        if target is None:
            binned = images.withColumns({"_bin": digit, "_from": F.lit(0).cast("long"), "_start": F.lit(0).cast("long")})
        else:
            upper = target.select(*keys, F.col("_bin").alias("_from"), F.col("_below").alias("_start"))
            binned = join_on(images.withColumn("_from", F.shiftright("_image", bits + DIGIT)), upper, [*keys, "_from"], "inner").withColumn("_bin", digit)
        counts = binned.groupBy(*keys, "_from", "_start", "_bin").agg(F.count("*").alias("_c"))
        upto = Window.partitionBy(*keys, "_from").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("_below", F.col("_start") + F.sum("_c").over(upto) - F.col("_c"))
        if target is None:
            ranked = ranked.withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))
            at = F.array(*[(F.col("n") - 1) * F.lit(float(p)) for p in probs])
            # both neighbours of each quantile, as 0-based ranks
            ranked = ranked.withColumn("_wanted", F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(F.floor(p), F.ceil(p))))))
        else:
            ranked = join_on(ranked, target.select(*keys, F.col("_bin").alias("_from"), "n", "_wanted"), [*keys, "_from"], "inner")
        inside = F.filter("_wanted", lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c")))
        target = saved(ranked.withColumn("_wanted", inside).filter(F.size("_wanted") > 0).drop("_from", "_start"), "quantile-bins")
        if bits == 0 or (target.agg(F.max("_c")).first()[0] or 0) <= FEW:
            return target, bits


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one row per group; NULL and NaN don't count.

    Radix selection on the bits of the doubles: only bins that hold a wanted rank
    are looked into (``_bins_of_ranks``), so no task holds a group's values, however
    close together they lie. Columns: the keys, ``n`` and ``q0`` … in the order of
    ``probs``.
    """
    image = order_image(F.col("_v"))
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    images = saved(rows.select(*keys, image.alias("_image")), "images")
    target, bits = _bins_of_ranks(images, keys, probs)
    if bits == 0:
        found = target.select(*keys, "n", F.col("_bin").alias("_image"), F.explode("_wanted").alias("_rank"))
    else:
        inside = join_on(images.withColumn("_bin", F.shiftright("_image", bits)), target, [*keys, "_bin"], "inner")
        values = inside.groupBy(*keys, "_bin", "n", "_below", "_wanted", "_image").agg(F.count("*").alias("_m"))
        in_bin = Window.partitionBy(*keys, "_bin").orderBy("_image").rowsBetween(Window.unboundedPreceding, 0)
        placed = values.withColumn("_upto", F.sum("_m").over(in_bin) + F.col("_below"))
        here = F.filter("_wanted", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_m")))
        found = placed.select(*keys, "n", "_image", F.explode(here).alias("_rank"))
    # at most two values per quantile and group are left
    per_group = found.groupBy(*keys, "n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", double_of_image(F.col("_image")).alias("_v")))).alias("_at")
    )

    def interpolated(p: float) -> Column:
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.element_at("_at", F.floor(pos)), F.element_at("_at", F.ceil(pos))
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (pos - F.floor(pos)))

    return per_group.select(*keys, "n", *[interpolated(p).alias(f"q{i}") for i, p in enumerate(probs)])
