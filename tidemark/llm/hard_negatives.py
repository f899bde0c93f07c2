"""Hard negatives by threshold joins over a pruned inverted index (L2AP), thresholds lowered until every window is full."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.best import MOST, Best
from tidemark.llm.common import save, with_missing
from tidemark.session import scratch_dir

#: Components of the anchors that are searched for at once, so that a block fits every task; vectors and anchors compared at once.
BLOCK, ROWS, ANCHORS = 1 << 18, 1024, 512
#: Groups of dimensions that the index is built and pruned by.
PARTS = 8
#: Thresholds of the positives as shares of the anchor's product with itself, of the negatives as shares of the positive's score.
#: The last of each takes what is left: everything, and the window's own lower end.
POSITIVE_SHARES, NEGATIVE_SHARES = (0.5, 0.2), (0.95, 0.88)
#: Room for rounding in bounds.
SLACK = 1 + 1e-9


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) of any finite double."""
    return math.floor(scale * x) if abs(x) < 1 << 60 else scale * int(x)


def _suffix_norms(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Norms of what follows each end."""
    squares = np.concatenate([np.zeros((len(x), 1)), np.cumsum((x * x)[:, ::-1], axis=1)], axis=1)
    return np.sqrt(squares[:, x.shape[1] - ends])


def threshold_join(q: np.ndarray, x: np.ndarray, least: np.ndarray):
    """Pairs (anchor, vector, product) of whole-numbered rows of q and x whose product is at least the anchor's threshold.

    A vector's trailing dimensions are left out of the index where their norm
    times the norm of the same dimensions of any anchor stays below that anchor's
    threshold: a pair that meets in none of the others can't reach it. Posting
    lists are walked a group of dimensions at a time; vectors indexed further come
    first, so a list is a leading run. After each group a pair goes unless its
    partial product and the product of the remaining norms reach the threshold.
    Pairs left over are multiplied out.
    """
    ends = np.linspace(0, x.shape[1], PARTS + 1).astype(int)
    qs, xs = _suffix_norms(q, ends), _suffix_norms(x, ends) * SLACK
    length = np.full(len(x), PARTS)
    if (least > 0).all():
        length = (xs * (qs / least[:, None]).max(0) >= 1).sum(1)
    rows = np.argsort(-length, kind="stable")[: np.count_nonzero(length)]
    length, part, xs = length[rows], x[rows], xs[rows]
    partial, alive = np.zeros((len(q), len(rows))), np.ones((len(q), len(rows)), bool)
    for s in range(PARTS):
        run = np.searchsorted(-length, -s, "left")
        here = slice(ends[s], ends[s + 1])
        partial[:, :run] += q[:, here] @ part[:run, here].T
        alive[:, :run] &= partial[:, :run] + qs[:, s + 1, None] * xs[None, :run, s + 1] >= least[:, None]
        hold = alive.any(0)
        if hold.sum() * 2 < len(hold):
            rows, length, part, xs, partial, alive = rows[hold], length[hold], part[hold], xs[hold], partial[:, hold], alive[:, hold]
    if alive.sum() * 8 > alive.size:
        products = q @ part.T
        a, r = np.nonzero(alive & (products >= least[:, None]))
        return a, rows[r], products[a, r].astype(np.int64)
    a, r = np.nonzero(alive)
    products = np.einsum("ij,ij->i", q[a], part[r])
    some = products >= least[a]
    return a[some], rows[r[some]], products[some].astype(np.int64)


def _wide_join(q: list[list[int]], x: list[list[int]], least: np.ndarray):
    """The same pairs of numbers of any size, multiplied out."""
    found = [(i, j, max(-MOST, min(MOST, sum(map(int.__mul__, a, b))))) for i, a in enumerate(q) for j, b in enumerate(x)]
    return tuple(np.array([p[c] for p in found if p[2] >= least[p[0]]], np.int64) for c in range(3))


class _Block:
    """Anchors of one block, their windows and the order of dimensions."""

    def __init__(self, ids, labels, vectors, dims, scale):
        self.ids, self.scale, self.dims = np.array(ids, np.int64), scale, np.array(dims, np.int64)
        self.names = {name: i for i, name in enumerate(sorted(set(labels)))}
        self.label = np.array([self.names[x] for x in labels])
        self.vectors = vectors
        with np.errstate(over="ignore"):
            whole = np.floor(scale * np.array(vectors, np.float64).reshape(len(ids), len(dims)))
        self.most = float(np.abs(whole).max(initial=0))
        self.q = whole[:, self.dims]
        self.own = [max(-MOST, min(MOST, sum(_whole(c, scale) ** 2 for c in v))) for v in vectors]


def _search(block: _Block, windows: list[tuple[int, int, int, int, bool]], same: bool, k: int):
    """The best k vectors per window (anchor, slot, lowest, highest score, last) among those of the same label, or of others."""
    count = max((w[1] for w in windows), default=0) + 1
    at = sorted({w[0] for w in windows})
    row = {a: i for i, a in enumerate(at)}
    lowest, highest = np.full((len(at), count), MOST, np.int64), np.full((len(at), count), -MOST, np.int64)
    last = np.zeros((len(at), count), bool)
    for a, slot, lo, hi, end in windows:
        lowest[row[a], slot], highest[row[a], slot], last[row[a], slot] = lo, hi, end
    ids, label, q = block.ids[at], block.label[at], block.q[at]
    exact = [[_whole(c, block.scale) for c in block.vectors[a]] for a in at] if block.most >= 1 << 20 else None

    def offered(best, a, r, score, vec_id, code):
        of = code[r]
        fit = (vec_id[r] != ids[a]) & ((of == label[a]) if same else (of != label[a]))
        a, r, score = a[fit], r[fit], score[fit]
        for slot in range(count):
            w = a * count + slot
            inside = (score >= np.maximum(lowest[a, slot], best.floor[w])) & (score <= highest[a, slot])
            best.offer(w[inside], score[inside], vec_id[r[inside]])

    def compare(best, vectors, vec_id, code):
        with np.errstate(over="ignore"):
            x = np.floor(block.scale * vectors)
        size = len(block.dims) or 1
        wide = ~(np.abs(x).max(1, initial=0) * max(block.most, 1.0) * size < 1 << 53)
        for start in range(0, len(at), ANCHORS):
            part = slice(start, start + ANCHORS)
            floor = best.floor.reshape(len(at), count)[part]
            least = np.maximum(lowest[part], floor).min(1)
            plain = np.flatnonzero(~wide)
            if len(plain):
                a, r, score = threshold_join(q[part], x[plain][:, block.dims], least.astype(np.float64))
                offered(best, a + start, plain[r], score, vec_id, code)
            beyond = np.flatnonzero(wide)
            if len(beyond):
                anchors = exact[part] if exact else [[int(c) for c in v] for v in np.floor(block.scale * np.array([block.vectors[i] for i in at[part]]))]
                a, r, score = _wide_join(anchors, [[_whole(c, block.scale) for c in vectors[i]] for i in beyond], least)
                offered(best, a + start, beyond[r], score, vec_id, code)

    def run(batches):
        best = Best(len(at) * count, k)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                code = np.array([block.names.get(x, -1) for x in part.column("label").to_pylist()], np.int64)
                vec_id = part.column("vec_id").to_numpy()
                vectors = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(vec_id), len(block.dims))
                if same:
                    some = np.isin(code, label)
                    vec_id, vectors, code = vec_id[some], vectors[some], code[some]
                if len(vec_id):
                    compare(best, vectors, vec_id, code)
        w, score, found = best.rows
        a, slot = w // count, w % count
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[a]), pa.array(slot.astype(np.int32)), pa.array(found), pa.array(score), pa.array(last[a, slot])],
            names=["anchor_id", "slot", "vec_id", "score", "last"],
        )

    return run


def _energy(batches):
    """Sums of squares per number of dimensions and dimension."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for v in batch.column(0).to_pylist():
            x = np.array(v, np.float64)
            with np.errstate(over="ignore"):
                total[len(v)] = total.get(len(v), 0.0) + x * x
    rows = [(size, i, float(e)) for size, t in total.items() for i, e in enumerate(t)]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["size", "dim", "energy"])


def hard_negatives(
    vectors: DataFrame, is_anchor: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """Negatives per anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id, label and embedding; ``is_anchor`` says which rows are
    anchors (those whose vec_id is divisible by 100 where it is left out). A score
    is the product of the vectors' components floor(scale * x). An anchor's
    positives are its best other rows of its label; a positive's negatives are the
    best rows of other labels whose score lies between low and high percent of the
    positive's. Higher scores come first, ties by smaller vec_id.

    Anchors are taken in blocks of bounded size, each held against all vectors
    where they lie: no pair is shuffled. Every search starts from a high threshold
    (``threshold_join``) and is repeated for the windows that it doesn't fill with a
    lower one, at last without any. Tasks keep the best few rows of a window;
    these are united by a ranked window and written. Scores are whole numbers, so
    results are exact.

    Defined results: rows take no part whose label, vector or vec_id is null or
    whose vector holds a null or non-finite component; vectors of another length
    than the anchor's aren't compared with it; a repeated vec_id stands for one
    row, the one of the smallest label, then vector; a score beyond 64 bits counts
    as the nearest 64-bit number; negative positive scores leave their window empty;
    other columns are ignored; without rows or anchors nothing is returned.
    """
    spark = vectors.sparkSession
    mark = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    rows = with_missing(vectors, vec_id="long", label="string", embedding="array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", "label", F.col("embedding").alias("v"))
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")
    rows = save(rows, "vectors")
    anchors = save(rows.where(mark), "anchors")
    order: dict[int, list] = {}
    for r in rows.select("v").mapInArrow(_energy, "size int, dim int, energy double").groupBy("size", "dim").agg(F.sum("energy").alias("e")).orderBy(F.desc("e"), "dim").collect():
        order.setdefault(r["size"], []).append(r["dim"])
    folder, written = {kind: scratch_dir(spark, kind) for kind in ("positives", "negatives")}, {"positives": 0, "negatives": 0}

    def search(kind: str, near: DataFrame, block: _Block, windows: list, same: bool, k: int) -> list:
        """Write the windows that this threshold fills or that it is the last one for; return their rows."""
        found = near.mapInArrow(_search(block, windows, same, k), "anchor_id long, slot int, vec_id long, score long, last boolean")
        ranked = Window.partitionBy("anchor_id", "slot")
        best = found.withColumn("rank", F.row_number().over(ranked.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        done = best.withColumn("n", F.count("*").over(ranked)).where((F.col("n") == k) | F.col("last")).select("anchor_id", "slot", "rank", "vec_id", "score")
        path = f"{folder[kind]}/part={written[kind]}"
        done.write.parquet(path)
        written[kind] += 1
        return spark.read.schema(done.schema).parquet(path).collect()

    wide = (F.exists("v", lambda x: F.abs(x) * scale >= 1 << 20)).alias("wide")
    for size, wide_block, n in [tuple(r) for r in anchors.groupBy(F.size("v").alias("size"), wide).count().collect()]:
        blocks = -(-n * max(size, 1) // BLOCK)
        near = rows.where(F.size("v") == size)
        for b in range(blocks):
            mine = anchors.where((F.size("v") == size) & (F.exists("v", lambda x: F.abs(x) * scale >= 1 << 20) == wide_block))
            held = mine.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
            if not held:
                continue
            block = _Block([r.vec_id for r in held], [r.label for r in held], [r.v for r in held], order.get(size, []), scale)
            place = {r.vec_id: i for i, r in enumerate(held)}
            todo, scores = set(place.values()), {}
            for share in (*POSITIVE_SHARES, None):
                windows = [(a, 0, -MOST if share is None else math.ceil(share * block.own[a]), MOST, share is None) for a in sorted(todo)]
                if not windows:
                    break
                for r in search("positives", near, block, windows, True, positives):
                    scores[place[r.anchor_id], r.rank - 1] = r.score
                    todo.discard(place[r.anchor_id])
            # score * 100 within low and high percent of the positive's
            ends = {key: (-(-low * s // 100), min(MOST, high * s // 100)) for key, s in scores.items()}
            todo = {key for key, (lo, hi) in ends.items() if lo <= hi}
            for share in (*NEGATIVE_SHARES, None):
                windows = []
                for a, slot in sorted(todo):
                    lo, hi = ends[a, slot]
                    t = lo if share is None else max(lo, math.ceil(share * scores[a, slot]))
                    windows.append((a, slot, min(t, hi), hi, min(t, hi) == lo))
                if not windows:
                    break
                for r in search("negatives", near, block, windows, False, negatives):
                    todo.discard((place[r.anchor_id], r.slot))
    schema = "anchor_id long, slot int, rank int, vec_id long, score long"
    held = {k: spark.read.schema(schema).parquet(*[f"{folder[k]}/part={i}" for i in range(n)]) if (n := written[k]) else spark.createDataFrame([], schema) for k in folder}
    best = held["positives"].select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = held["negatives"].select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(found, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
