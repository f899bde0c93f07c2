"""Near-duplicate vectors: a forest of random-projection trees with spill, exact comparison in leaves, union by components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import save, with_missing
from tidemark.llm.components import components

#: Trees; the size a leaf aims at; vectors compared at once; vectors per node that its splits are fitted on.
TREES, LEAF, BLOCK, SAMPLE = 4, 256, 512, 4096
#: Half the width of the overlap, in deviations of the projected distance of two vectors at the least similarity. Such a
#: pair is parted by one split with a probability of about 0.4 %.
SPILL = 0.8
#: A split is given up where its children hold more than this share of the parent together.
MOST = 1.5
#: Splits below one node per round; the next round fits the rest on fresh samples.
LEVELS = 7


def _unit(vectors) -> np.ndarray:
    """Vectors of length 1. The largest component is divided out first, so squares neither under- nor overflow."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    # as powers of two, which divide exactly and reach the smallest component
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _direction(tree: int, node: int, attempt: int, dim: int) -> np.ndarray:
    d = np.random.default_rng([tree, node & 0x7FFFFFFFFFFFFFFF, attempt]).standard_normal(dim)
    return d / np.linalg.norm(d)


def _child(node: int, side: int) -> int:
    """Number of a child node; 63 random bits, so that nodes of all trees and labels differ."""
    x = (node * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03 * (side + 1)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 31) >> 1


def _fit(similarity: float):
    """Splits below one node from its sample: node, direction, threshold."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", kind="stable")
        x, tree, root = _unit(p.v), int(p.tree.iloc[0]), int(p.node.iloc[0])
        margin = SPILL * (2 - 2 * similarity) ** 0.5 / x.shape[1] ** 0.5
        aim = LEAF * len(p) / int(p["size"].iloc[0])
        splits, todo = [], [(root, np.arange(len(x)), 0)]
        while todo:
            node, at, level = todo.pop()
            if len(at) <= max(aim, 16) or level == LEVELS:
                continue
            best = None
            for attempt in range(4):
                y = x[at] @ _direction(tree, node, attempt, x.shape[1])
                t = float(np.median(y))
                left, right = at[y <= t + margin], at[y > t - margin]
                if best is None or len(left) + len(right) < best[0]:
                    best = len(left) + len(right), attempt, t, left, right
            total, attempt, t, left, right = best
            if total > MOST * len(at) or max(len(left), len(right)) == len(at):
                continue
            splits.append((node, attempt, t))
            todo += [(_child(node, 0), left, level + 1), (_child(node, 1), right, level + 1)]
        blob = np.array(splits, dtype=[("node", "<i8"), ("attempt", "<i4"), ("t", "<f8")]).tobytes()
        return pd.DataFrame({"tree": [tree], "node": [root], "splits": [blob]}).astype({"tree": "int32"})

    return run


def _route(similarity: float):
    def run(frames):
        for p in frames:
            if not len(p):
                continue
            out = []
            for (tree, root), g in p.groupby(["tree", "node"], sort=False):
                splits = {int(n): (int(a), float(t)) for n, a, t in np.frombuffer(g.splits.iloc[0], dtype=[("node", "<i8"), ("attempt", "<i4"), ("t", "<f8")])}
                x = _unit(g.v)
                margin = SPILL * (2 - 2 * similarity) ** 0.5 / x.shape[1] ** 0.5
                todo = [(int(root), np.arange(len(g)))]
                while todo:
                    node, at = todo.pop()
                    if node not in splits:
                        h = g.iloc[at][["tree", "id", "v", "copies"]].copy()
                        h["node"], h["final"] = node, node == root
                        out.append(h)
                        continue
                    attempt, t = splits[node]
                    y = x[at] @ _direction(int(tree), node, attempt, x.shape[1])
                    todo += [(_child(node, s), part) for s, part in ((0, at[y <= t + margin]), (1, at[y > t - margin])) if len(part)]
            yield pd.concat(out)[["tree", "node", "id", "v", "copies", "final"]]

    return run


def _compare(similarity: float):
    """Links of one block pair that this leaf is the first to hold: counts per vector, and enough links to span each group."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["id", "side"], kind="stable").drop_duplicates("id")
        x, ids, copies, side = _unit(p.v), p.id.to_numpy(), p.copies.to_numpy(), p.side.to_numpy()
        leaf = int(p.node.iloc[0])
        earlier = sorted({n for own in p.leaves for n in own if n < leaf})
        column = {n: i for i, n in enumerate(earlier)}
        held = np.zeros((len(p), len(earlier)), np.float32)
        for i, own in enumerate(p.leaves):
            held[i, [column[n] for n in own if n < leaf]] = 1
        linked = (x @ x.T >= similarity) & (held @ held.T == 0) & (ids[:, None] != ids[None, :])
        if side.min() != side.max():
            linked &= side[:, None] != side[None, :]
        counts = linked @ copies
        root = np.arange(len(p))
        for i in np.flatnonzero(counts):  # flood from the smallest id of each group
            if root[i] != i:
                continue
            reached, edge = linked[i].copy(), linked[i]
            while edge.any():
                edge = linked[edge].any(0) & ~reached
                reached |= edge
            root[np.flatnonzero(reached & (np.arange(len(p)) > i))] = i
        some = np.flatnonzero(counts)
        return pd.DataFrame({"a": ids[some], "b": ids[root[some]], "n": counts[some]}).astype("int64")

    return run


def near_duplicate_vectors(vectors: DataFrame, similarity: float = 0.98) -> DataFrame:
    """One row per row of vectors (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Rows of one label and dimension are linked at a cosine of similarity or more,
    in double precision. Equal vectors form a class first and count as its copies.
    Each node of each tree is split on at most SAMPLE of its vectors, every vector
    is routed, and those near a split go to both sides. Rounds go on below nodes
    that are still large; a node that no direction parts is compared block by
    block, so no leaf is capped. A pair that shares several leaves counts in the
    one of the smallest number; leaves give counts and spanning links, never all
    their pairs. All links reported are exact; a link is missed only if all trees
    part it.

    Defined results: null labels, and vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing and stand alone; huge and tiny
    finite components count by their direction like any others; repeated rows
    are vectors of their own; rows without vec_id have no component and are kept;
    other columns are ignored.
    """
    rows = with_missing(vectors, vec_id="long", label="string", embedding="array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "label", F.when(good, F.col("embedding")).alias("v"))
    classes = save(rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
    node = F.shiftrightunsigned(F.xxhash64("tree", "label", F.size("v")), 1)
    now = classes.withColumn("tree", F.explode(F.array(*[F.lit(i) for i in range(TREES)]))).select("tree", node.alias("node"), "id", "v", "copies", F.lit(False).alias("final"))
    done = []
    now = save(now, "roots")
    while True:
        size = now.groupBy("tree", "node").agg(F.count("*").alias("size"), F.max("final").alias("final"))
        large = save(size.where(f"size > {LEAF} and not final").drop("final"), "large")
        if large.isEmpty():
            done.append(now.drop("final"))
            break
        done.append(now.join(large, ["tree", "node"], "left_anti").drop("final"))
        held = now.drop("final").join(large, ["tree", "node"])
        sampled = held.where(F.pmod(F.xxhash64("id", "tree"), F.col("size")) < SAMPLE)
        splits = sampled.groupBy("tree", "node").applyInPandas(_fit(similarity), "tree int, node long, splits binary")
        now = save(held.drop("size").join(save(splits, "splits"), ["tree", "node"]).mapInPandas(_route(similarity), "tree int, node long, id long, v array<double>, copies long, final boolean"), "routed")
    leaves = done[0]
    for d in done[1:]:
        leaves = leaves.unionByName(d)
    own = leaves.groupBy("id").agg(F.sort_array(F.collect_set("node")).alias("leaves"))
    sizes = leaves.groupBy("tree", "node").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = leaves.join(sizes, ["tree", "node"]).join(own, "id").withColumn("mine", mine).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "tree", "node", "id", "v", "copies", "leaves", F.least("mine", "o").alias("lo"), F.greatest("mine", "o").alias("hi"),
        F.when(F.col("mine") == F.col("o"), 2).when(F.col("mine") < F.col("o"), 0).otherwise(1).alias("side"),
    )
    found = save(dealt.groupBy("tree", "node", "lo", "hi").applyInPandas(_compare(similarity), "a long, b long, n long"), "links")
    comps = components(found.select("a", "b"))
    per_class = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    known = classes.join(per_class, "id", "left").join(comps, "id", "left").select("label", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    out = rows.join(known, ["label", "v"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
