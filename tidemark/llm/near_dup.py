"""Near-duplicate documents: SuperMinHash, banding, exact verification, union by components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, save, whole_row, with_missing
from tidemark.llm.components import components
from tidemark.llm.hashing import U, mix, shingles, signed, texts_of, word_hashes
from tidemark.llm.superminhash import bands, signatures

#: Rows of a band and bands: at similarity 0.8 a pair shares no band with probability (1 - 0.8**6)**54 = 8e-8.
ROWS, BANDS = 6, 54
#: Documents and shingles signed together.
DOCS, HELD = 1024, 1 << 19
#: Members of a bucket compared in one task, on full sets and on sketches; larger buckets are compared block by block.
MEMBERS, SKETCHED = 512, 4096
#: A sketch is one bit a slot of the signature. Sets at similarity 0.8 differ in more than this share of bits, which is
#: expected of sets at 0.56, less than once in 10**9.
APART = 0.22
SKETCH = [f"k{i}" for i in range(-(-ROWS * BANDS // 64))]


def _sign(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), *[(k, pa.int64()) for k in SKETCH]])

    def flush(ids, sets):
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))  # small sets take more steps: let them walk together
        owner = np.repeat(order, [len(sets[i]) for i in order])
        sig = signatures(np.concatenate([sets[i] for i in order]), owner, len(sets), ROWS * BANDS)
        keys = signed(bands(sig, ROWS))
        bits = np.zeros((len(sets), 64 * len(SKETCH)), np.uint8)
        bits[:, : sig.shape[1]] = (mix(sig) & U(1)).astype(np.uint8)
        sketch = np.packbits(bits, axis=1).view(np.int64)
        rows = []
        for i, s in enumerate(sets):
            s1, s2 = (int(np.add.reduce(mix(s ^ U(c)), dtype=U).astype(np.int64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
            rows.append((ids[i], len(s), s1, s2, keys[i] if len(s) else [], *sketch[i]))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        ids, sets, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                for doc_id, words in zip(part.column(0).to_pylist(), word_hashes(texts_of(part.column(1)))):
                    ids.append(doc_id)
                    sets.append(shingles(words, shingle))
                    held += len(sets[-1])
                    if held >= HELD or len(ids) >= DOCS:
                        yield flush(ids, sets)
                        ids, sets, held = [], [], 0
        if ids:
            yield flush(ids, sets)

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS // 4):
                part = batch.slice(at, DOCS // 4)
                sets = [signed(shingles(w, shingle)) for w in word_hashes(texts_of(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "h"])

    return run


def _across(percent: int):
    """Links between members of different components in one block pair of a bucket, by exact intersections; enough to unite them."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["id", "side"], kind="stable").drop_duplicates("id")
        ids, comp, side = p.id.to_numpy(), p.comp.to_numpy(), p.side.to_numpy()
        sizes = np.array([len(h) for h in p.h])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        seen, codes = np.unique(np.concatenate(list(p.h)), return_inverse=True)
        kinds, where = np.unique(comp, return_inverse=True)
        root = np.arange(len(kinds))  # of components, as they are united here
        out = []
        for i in np.flatnonzero(where != np.bincount(where).argmax()):  # one of two different components isn't the commonest
            mark = np.zeros(len(seen), np.int32)
            mark[codes[starts[i] : starts[i] + sizes[i]]] = 1
            shared = np.add.reduceat(mark[codes], starts)
            close = (shared * 100 >= (sizes[i] + sizes - shared) * percent) & ((side[i] == 2) | (side != side[i]))
            for j in np.flatnonzero(close & (root[where] != root[where[i]])):
                x, y = root[where[i]], root[where[j]]
                if x != y:
                    root[root == max(x, y)] = min(x, y)
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked by their full sets."""
    left, right = (sets.select(F.col("id").alias(k), F.col("h").alias(f"h{k}")).hint("merge") for k in ("a", "b"))
    both = pairs.join(right, "b").join(left, "a")
    na, nb = F.size("ha"), F.size("hb")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(shared * 100 >= (na + nb - shared) * percent).select("a", "b")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose sketches are near."""
    def named(x: str) -> DataFrame:
        return sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), *[F.col(k).alias(f"{k}{x}") for k in SKETCH]).hint("merge")

    both = pairs.join(named("b"), "b").join(named("a"), "a")
    apart = sum((F.bit_count(F.col(f"{k}a").bitwiseXOR(F.col(f"{k}b"))) for k in SKETCH), F.lit(0))
    return both.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (apart <= int(APART * ROWS * BANDS))).select("a", "b")


def _near_others(percent: int):
    """Members that look like one of another component in one block pair of a bucket, by sizes and sketches."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["id", "side"], kind="stable").drop_duplicates("id")
        n, comp, side = p.n.to_numpy(), p.comp.to_numpy(), p.side.to_numpy()
        sketch = p[SKETCH].to_numpy(np.int64).view(np.uint64)
        hit = np.zeros(len(p), bool)
        kinds, where = np.unique(comp, return_inverse=True)
        for i in np.flatnonzero(where != np.bincount(where).argmax()):  # one of two different components isn't the commonest
            apart = np.bitwise_count(sketch ^ sketch[i]).sum(axis=1)
            near = (apart <= int(APART * ROWS * BANDS)) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent) & (where != where[i])
            near &= (side[i] == 2) | (side != side[i])
            hit |= near
            hit[i] |= near.any()
        return pd.DataFrame({"key": p["key"][hit], "id": p["id"][hit], "comp": comp[hit]}).astype("int64")

    return run


def _mixed(members: DataFrame) -> DataFrame:
    """(key, main, size, strays) of the buckets of members (key, id, comp) with several components: the commonest one, all members and those of other ones."""
    kinds = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = F.max_by("comp", F.struct("n", "comp"))
    return kinds.groupBy("key").agg(main.alias("main"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("strays")).where("strays > 0")


def _in_blocks(members: DataFrame, mixed: DataFrame, width: int) -> DataFrame:
    """Members of mixed buckets (key, id, comp, ...) once for every pair of blocks of their bucket (lo, hi) that they belong to.

    In a bucket of more than width members strays have blocks of their own, which
    meet all blocks; blocks of the commonest component meet those of strays only.
    A member of it is there once where the strays fill one block.
    """
    stray, whole = F.col("comp") != F.col("main"), F.col("size") <= width
    few = F.ceil(F.col("strays") / width).cast("int")
    many = F.ceil((F.col("size") - F.col("strays")) / width).cast("int")
    dealt = F.xxhash64("id")
    own = F.when(whole, 0).when(stray, F.pmod(dealt, few)).otherwise(few + F.pmod(dealt, many)).cast("int")
    last = F.when(whole, 0).when(stray, few + many - 1).otherwise(few - 1)
    dealt = members.join(mixed.hint("merge"), "key").withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), last)))
    side = F.when(F.col("own") == F.col("o"), 2).when(F.col("own") < F.col("o"), 0).otherwise(1)
    return dealt.withColumns({"lo": F.least("own", "o"), "hi": F.greatest("own", "o"), "side": side}).drop("own", "o", "main", "size", "strays")


def _merged(members: DataFrame, mixed: DataFrame) -> DataFrame:
    """Members (key, id, comp) of mixed buckets, those of one commonest component as one bucket where that takes no more comparisons.

    Near copies meet in up to BANDS buckets; so each is dealt once and no pair is looked at again and again.
    """
    met = members.join(mixed.select("key", "main").hint("merge"), "key")
    once = met.groupBy("main", "id", "comp").agg(F.count("*")).groupBy("main").agg((F.count("*") * F.count_if(F.col("comp") != F.col("main"))).alias("together"))
    apart = mixed.groupBy("main").agg(F.sum(F.col("size") * F.col("strays")).alias("apart"), F.min("key").alias("one"))
    ones = apart.join(once.hint("merge"), "main").where("together <= apart").select("main", "one")
    named = mixed.join(ones.hint("merge"), "main", "left").select("key", F.coalesce("one", "key").alias("bucket"))
    return members.join(named.hint("merge"), "key").select(F.col("bucket").alias("key"), "id", "comp").distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Saved full sets of the wanted ids. Texts are dealt by id whatever their number, so that the plan is one at every size."""
    texts = docs.withColumnRenamed("doc_id", "id").join(wanted.hint("merge"), "id", "left_semi")
    return save(texts.mapInArrow(_sets(shingle), "id long, h array<long>").dropDuplicates(["id"]), "sets")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of word shingles have a Jaccard
    similarity of percent / 100 or more; component_id is the smallest doc_id
    reachable by links and kept marks it. Words are separated by ASCII white
    space and A-Z lower-cased.

    1. Documents with equal sets form a class by a 128-bit hash of the set; only
       each class's smallest doc_id goes on.
    2. Buckets of equal bands name their smallest member leader; every member that
       sizes and sketches don't rule out is verified against its leaders on the full
       sets, and links are united.
    3. Buckets that then hold several components are mixed. Those of one commonest
       component become one where that takes no more comparisons.
    4. Mixed buckets are looked through by sketches,
       block by block, for members that may have a link to another component; these
       are compared on their full sets. No bucket is capped, no pair inside a
       component is needed, and only links that unite leave a task.

    What several steps read is saved, and joins that small tables would turn into
    broadcasts are merged: plans stay small and the driver holds no table, at every size.

    Defined results: null or blank texts have an empty set and link with nothing;
    fewer words than the shingle's length are one shingle; rows that repeat a
    doc_id count as one document for components; rows without doc_id have no
    component and are kept; other columns are ignored.
    """
    docs = with_missing(docs, doc_id="long", text="string")
    sketch = ", ".join(f"{k} long" for k in SKETCH)
    signed_docs = save(docs.mapInArrow(_sign(shingle), f"doc_id long, n long, s1 long, s2 long, bands array<long>, {sketch}"), "signatures")
    some = signed_docs.where("n > 0 and doc_id is not null")
    classes = save(some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    first = classes.select(F.col("rep").alias("doc_id"), "s1", "s2", "n").hint("merge")
    reps = some.join(first, ["doc_id", "s1", "s2", "n"], "left_semi")
    sketches = save(reps.select(F.col("doc_id").alias("id"), "n", *SKETCH).dropDuplicates(["id"]), "sketches")
    keyed = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    # one bucket of all those that hold the same members: bands of copies agree again and again
    whose = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"m{i}") for i in (0, 1)]
    shared = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("other"), F.count("*").alias("size"), *whose).where("leader <> other")
    shared = shared.groupBy("leader", "other", "size", "m0", "m1").agg(F.min("key").alias("key"))
    members = save(keyed.join(shared.select("key", "leader", "size").hint("merge"), "key"), "buckets")

    pairs = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    likely = save(_likely(pairs, sketches, percent), "likely")
    sets = _sets_of(docs, likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), shingle)
    done = save(_verified(likely, sets, percent), "verified")
    drop(sets, likely)
    comps = components(done)
    # a bucket of two is settled by its leader
    placed = members.where("size > 2").join(comps.hint("merge"), "id", "left").select("id", "key", F.coalesce("component", "id").alias("comp"))
    placed = save(placed, "placed")
    mixed = save(_mixed(placed), "mixed")
    met = save(_merged(placed, mixed), "met")
    drop(members, placed, mixed)
    kinds = "key long, id long, comp long"
    dealt = _in_blocks(met.join(sketches.hint("merge"), "id"), _mixed(met), SKETCHED)
    near = save(dealt.groupBy("key", "lo", "hi").applyInPandas(_near_others(percent), kinds).distinct(), "near-others")
    sets = _sets_of(docs, near.select("id").distinct(), shingle)
    dealt = _in_blocks(near, _mixed(near), MEMBERS).join(sets.hint("merge"), "id")
    across = save(dealt.groupBy("key", "lo", "hi").applyInPandas(_across(percent), "a long, b long"), "across")
    drop(met, sketches, sets, near, comps)
    comps = components(done.unionByName(across))
    known = classes.join(comps.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = (
        signed_docs.select("doc_id", "n", "s1", "s2")
        .join(known.hint("merge"), ["s1", "s2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    found = save(out, "groups")
    drop(signed_docs, classes, done, across, comps)
    return found


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, the one of the smallest doc_id; all columns stay.

    Of rows that repeat a kept doc_id one stays; rows without doc_id all stay.
    """
    found = near_duplicates(docs, shingle, percent)
    out = docs.join(found.where("not kept").select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    if found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        return out
    nth = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("nth")
    return out.select(whole_row(out), "doc_id", nth).dropDuplicates(["doc_id", "nth"]).select("row.*")
