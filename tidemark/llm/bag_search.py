"""Ranked lexical search: documents of one bag of item terms are scored once."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.best import Best
from tidemark.llm.common import save, with_missing
from tidemark.llm.licenses import words_of

#: Items searched for together; cells of a table of classes and terms, or of classes and items, held at once; texts read at once.
ITEMS, CELLS, TEXTS = 1024, 1 << 21, 1024
#: Stands for a missing doc_id, which comes last among ties.
NO_ID = (1 << 63) - 1


def _bag(codes: np.ndarray, counts: np.ndarray) -> bytes:
    return codes.astype("<u4").tobytes() + counts.astype("<u4").tobytes()


def _opened(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(bag, "<u4")
    return both[: len(both) // 2].astype(np.int64), both[len(both) // 2 :].astype(np.int64)


def _bags(code: dict[bytes, int]):
    """Per document its number of terms and how often it holds each of the items' terms."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                n, bags = [], []
                for text in part.column(1).cast("binary").to_pylist():
                    words = words_of(text or b"")
                    held = np.array([c for c in map(code.get, words) if c is not None], np.int64)
                    n.append(len(words))
                    bags.append(_bag(*np.unique(held, return_counts=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])

    return run


def _holders(terms: int):
    """How many bags hold each term."""

    def run(batches):
        held = np.zeros(terms, np.int64)
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                held[_opened(bag)[0]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["term", "df"])

    return run


def term_weight(holders: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def _scored(weight: np.ndarray, items: list[Counter], k: int):
    """The best k classes per item: item (by number), score and the class's first doc_id, hash and m."""
    # whole numbers below 2**53 are exact in doubles, whose products are fast
    most = max((int(weight.max(initial=0)) * 1_000_000 * sum(i.values()) for i in items), default=0)
    table = np.zeros((len(weight), len(items)), np.float64 if most < 1 << 53 else np.int64)
    for i, item in enumerate(items):
        for term, times in item.items():
            table[term, i] = times
    rows = max(16, CELLS // max(1, *table.shape))

    def run(batches):
        best = Best(len(items), k, more=2)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                m = part.column("m").to_numpy()
                value = np.zeros((part.num_rows, len(weight)), table.dtype)
                for r, bag in enumerate(part.column("bag").to_pylist()):
                    term, tf = _opened(bag)
                    value[r, term] = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[r]))
                score = (value @ table).astype(np.int64)
                least = np.maximum(best.floor, 1)
                if len(score) > k:
                    least = np.maximum(least, np.partition(score, len(score) - k, axis=0)[len(score) - k])
                r, i = np.nonzero(score >= least)
                first, h = part.column("first").to_numpy(), part.column("h").to_numpy()
                best.offer(i, score[r, i], first[r], h[r], m[r])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows], names=["item", "score", "first", "h", "m"])

    return run


def _search_block(bags: DataFrame, n_documents: int, n_terms: int, code: dict[bytes, int], items: list[tuple[int, Counter]], k: int) -> DataFrame:
    spark = bags.sparkSession
    df = {r.term: r.df for r in bags.select("bag").mapInArrow(_holders(len(code)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = np.array([term_weight(df.get(t, 0), n_documents) for t in range(len(code))], np.int64)
    m = F.expr(f"75L + (25L * n * {n_documents}L) div {max(n_terms, 1)}L")
    held = bags.where(F.length("bag") > 0).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), m.alias("m"), "bag").withColumn("h", F.xxhash64("bag", "m"))
    classes = save(held.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")), "classes")
    found = classes.mapInArrow(_scored(weight, [c for _, c in items], k), "item long, score long, first long, h long, m long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "first", "h")
    top = save(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "top")
    # a class of one is its document; larger ones are looked up by hash and verified bag by bag
    chosen = top.select("h", "m", "first").distinct()
    wanted = save(classes.where("size > 1").join(chosen, ["h", "m", "first"]).select("h", "m", "bag", "first"), "wanted")
    members = held.join(wanted.withColumnRenamed("bag", "same"), ["h", "m"]).where("bag = same").select("h", "m", "first", "doc_id")
    by_id = Window.partitionBy("h", "m", "first").orderBy("doc_id")
    members = save(members.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k).drop("nth"), "members")
    docs = top.join(members, ["h", "m", "first"], "left").select("item", "score", F.coalesce("doc_id", "first").alias("doc_id"))
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item long, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score; docs has doc_id and text, items item_id and text.

    Terms are runs of letters, digits and everything beyond ASCII, A-Z lower-cased.
    With N documents that have terms, L terms in all, n terms in a document, tf and
    df of a term: its weight is floor(1000 ln((2N + 2) / (2df + 1))), the document's
    m is 75 + 25nN div L, and its score sums weight * (10**9 tf div (1000 tf + 12m))
    over the item's terms, repeats included. Equal scores go by doc_id; documents
    without a score stay out.

    Every whole text is reduced to its bag, its counts of the items' terms. Documents
    of equal bag and m form a class: grouped by a hash, the bag and m, which verifies
    the bytes. Each class is scored once, and the k best classes of an item hold its k
    best documents, for each class has one at least. Only they are expanded: members
    meet the class's hash, are verified, and the first k by doc_id are found map-side
    first, so a class of any size stays spread. Items go in blocks of about ITEMS,
    whose terms ride along; statistics are counted over all documents.

    Defined results: null or blank texts have no terms and count for nothing; rows
    that repeat a doc_id are documents of their own and may each be ranked; a missing
    doc_id comes last among equal scores; items without terms, or without item_id,
    return nothing; a repeated item_id stands for its smallest text; other columns
    are ignored; empty tables return nothing.
    """
    spark = docs.sparkSession
    docs = with_missing(docs, doc_id="long", text="string")
    items = save(with_missing(items, item_id="long", text="string").where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text")), "items")
    blocks = max(1, -(-items.count() // ITEMS))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = [(r.item_id, words_of((r.text or "").encode())) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()]
        code = {w: i for i, w in enumerate(sorted({w for _, words in block for w in words}))}
        if not code:
            continue
        bags = save(docs.mapInArrow(_bags(code), "doc_id long, n long, bag binary"), "bags")
        counts = bags.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        coded = [(i, Counter(code[w] for w in words)) for i, words in block if words]
        out = out.unionByName(save(_search_block(bags, counts.docs, counts.terms, code, coded, k), "ranks"))
    return out
