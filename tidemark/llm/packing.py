"""Best-fit packing of token pieces by minimum bin slack."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.llm.byte_bpe import ByteBPE
from tidemark.llm.common import save, whole_row, with_missing

#: Rows numbered together within one length.
RUN = 16384


def tokenizer_files() -> tuple[str, str]:
    """Vocabulary file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, size: int = 1024, end: int = 2, files: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids: the token ids of every text and one end id, cut into pieces of at most size tokens.

    ids is binary, unsigned 32-bit little-endian. Only texts of more than size
    tokens are cut; all their pieces but the first have size tokens. Null text is
    empty and gives the end id alone. Rows that repeat a doc_id give their own
    pieces; other columns are ignored.
    """
    vocabulary, ranks = files or tokenizer_files()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        bpe, last = ByteBPE.at(vocabulary, ranks), int(end).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = bpe.ids(text or "") + last
                    n = len(ids) // 4
                    cut = (n - 1) % size + 1 if n > size else n
                    bounds = [0, *range(cut, n + 1, size)]
                    rows += [(doc_id, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return with_missing(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def minimum_bin_slack(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (how many of each length) and how often each is packed, for counts per length.

    The longest item left opens a bin. A bitset of reachable sums over the
    lengths left finds the fullest combination for the rest of the bin; it is
    removed as often as the counts allow before the next search, so the work
    depends on the number of lengths and not on the number of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        longest = max(left)
        room = size - longest
        reach, steps = 1, []
        for n in sorted((n for n in left if n <= room), reverse=True):
            have = min(left[n] - (n == longest), room // n)
            before, width = reach, 1
            while have > 0:  # multiples by doubling
                take = min(width, have)
                reach |= reach << (take * n)
                have -= take
                width *= 2
            reach &= (1 << (room + 1)) - 1
            steps.append((n, before))
            if reach >> room & 1:
                break
        total, pattern = reach.bit_length() - 1, {longest: 1}
        for n, before in reversed(steps):
            while not before >> total & 1:
                total -= n
                pattern[n] = pattern.get(n, 0) + 1
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((pattern, times))
    return out


def _placement(plan: list[tuple[dict[int, int], int]], size: int):
    """Arrays over (length, first rank): which bins and offsets the ranks of a length get."""
    rows, used, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            rows.append((n, used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    rows.sort()
    return [np.array(c, np.int64) for c in zip(*rows)] or [np.empty(0, np.int64)] * 5


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset; length must be 1 to size, other columns ride along.

    Only the count of each length, size numbers at most, meets the driver. Rows
    of a length are numbered in runs whose number follows the table's size, so a
    length that a third of all pieces share is dealt to many tasks. sequence_id
    counts from 0, pieces of a sequence fill it without gaps from offset 0. An
    empty table gives an empty result; input columns sequence_id and offset are
    replaced.
    """
    riding = whole_row(pieces.drop("sequence_id", "offset"))
    rows = save(pieces.select(riding, "length", F.monotonically_increasing_id().alias("_row")), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= n <= size for n in histogram):
        raise ValueError("lengths must be 1 to size")
    placed = _placement(minimum_bin_slack(histogram, size), size)
    length, rank_from, times, first, offset = placed
    key = length * (1 << 50) + rank_from
    runs = max(64, -(-sum(histogram.values()) // RUN))
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("_row"), F.lit(runs)).cast("int"))
    per_run = rows.groupBy("length", "_run").agg(F.count("*").alias("n"))
    before = per_run.select("length", "_run", (F.sum("n").over(W.partitionBy("length").orderBy("_run")) - F.col("n")).alias("_before"))
    numbered = rows.withColumn("_nth", F.row_number().over(W.partitionBy("length", "_run").orderBy("_row"))).join(before, ["length", "_run"])
    ranked = numbered.select("row", "length", (F.col("_before") + F.col("_nth") - 1).alias("rank"))
    schema = T.StructType([ranked.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for b in batches:
            n, rank = (np.asarray(b.column(c).cast(pa.int64())) for c in ("length", "rank"))
            at = np.searchsorted(key, n * (1 << 50) + rank, side="right") - 1
            k = rank - rank_from[at]
            got = [pa.array(first[at] + k // times[at]), pa.array(offset[at] + k % times[at] * n)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *got], names=schema.names)

    return ranked.mapInArrow(place, schema).select("row.*", "sequence_id", "offset")


def placements(docs: DataFrame, size: int = 1024) -> DataFrame:
    """Token pieces of documents and their places, with the crc32 of each piece's ids instead of the ids."""
    pieces = token_pieces(docs, size).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, size)
