"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_of_id, save, with_missing

#: Labelled examples per class that the index holds, a bounded sample by hash of the id; terms it is fitted on.
EXAMPLES, TERMS = 2048, 4096
#: Neighbours that vote; examples per block of the index; doubt a term must overcome beyond the number of terms looked at.
NEIGHBOURS, BLOCK, DOUBT = 15, 64, 5.0
#: Terms are whole words and the beginnings of longer ones, so that unseen endings are recognised.
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


class Vocabulary:
    """Numbers of the chosen terms of a word; most words are told by their first characters to have none."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.heads = {t.rstrip("*")[: BEGINNINGS[0]] for t in terms}

    def __getitem__(self, word: str) -> tuple[int, ...]:
        return tuple(self.number[t] for t in terms_of(word) if t in self.number)

    def counts(self, text: str | None) -> Counter:
        heads, n = self.heads, BEGINNINGS[0]
        return Counter(i for w in _WORD.findall((text or "").lower()) if w[:n] in heads for i in self[w])


class BlockMaxIndex:
    """Exact top-k cosine: blocks are visited by falling upper bound until none can hold a better example."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        order = sorted(range(len(vectors)), key=lambda i: (max(vectors[i], key=lambda t: (vectors[i][t], -t)), i))  # like examples share blocks
        self.order = np.array(order, np.int64)
        n_blocks = -(-len(order) // BLOCK)
        self.postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(n_terms)]
        self.top = np.zeros((n_terms, n_blocks))
        held: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for place, i in enumerate(order):
            for t, w in vectors[i].items():
                held.setdefault((t, place // BLOCK), []).append((place % BLOCK, w))
        for (t, b), p in held.items():
            at, w = (np.array(x) for x in zip(*p))
            self.postings[t][b] = at, w
            self.top[t, b] = w.max()

    def nearest(self, query: dict[int, float], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) by falling cosine, then by number; skip leaves one example out."""
        terms = sorted(query)
        bound = np.array([query[t] for t in terms]) @ self.top[terms] if terms else np.zeros(0)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for t in terms:
                if b in self.postings[t]:
                    at, w = self.postings[t][b]
                    scores[at] += query[t] * w
            found = [(float(scores[j]), int(self.order[b * BLOCK + j])) for j in np.flatnonzero(scores)]
            best = sorted([*best, *(x for x in found if x[1] != skip)], key=lambda x: (-round(x[0], 12), x[1]))[:k]
        return best


class Model:
    """Vocabulary, weights, index, and the calibration of votes."""

    def __init__(self, terms: list[str], document_counts: list[int], n_docs: int, examples: list[tuple[dict[int, int], int, int]], share: float):
        self.words = Vocabulary(terms)
        self.idf = [math.log((1 + n_docs) / (1 + d)) + 1 for d in document_counts]
        vectors = [(self.vector(c), y, i) for c, y, i in examples]
        some = [v for v in vectors if v[0]]
        self.labels, self.ids = [y for _, y, _ in some], [i for _, _, i in some]
        self.index = BlockMaxIndex([v for v, _, _ in some], len(terms)) if some else None
        # weights that bring the sample back to the share of labels among all labelled rows
        toxic = sum(y for _, y, _ in vectors)
        self.weight = {1: share / max(toxic, 1), 0: (1 - share) / max(len(vectors) - toxic, 1)}
        unit = max(len(vectors), 1)
        none = [self.weight[y] * unit for v, y, _ in vectors if not v for y in (y,)]
        none_toxic = sum(self.weight[1] * unit for v, y, _ in vectors if not v and y)
        self.without = (none_toxic + share) / (sum(none) + 1)  # nothing known: the share itself
        self.levels = [0.5 * (i + 0.5) / 5 for i in range(10)]
        self._calibrate([(self.vote(v, skip=j)[0], y) for j, (v, y, _) in enumerate(some)], unit)

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(c)) * self.idf[t] for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    def vote(self, vector: dict[int, float], skip: int = -1) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(vector, NEIGHBOURS, skip)
        weight = [(s * s, self.labels[i]) for s, i in near]
        return (sum(w for w, y in weight if y) + 1e-9) / (sum(w for w, _ in weight) + 2e-9), near

    def _calibrate(self, votes: list[tuple[float, int]], unit: int) -> None:
        """Toxic share per tenth of the vote over left-out examples, smoothed towards the tenth's own middle and made monotone."""
        tenth = [(0.0, 0.0)] * 10
        for vote, y in votes:
            a, n = tenth[min(int(vote * 10), 9)]
            tenth[min(int(vote * 10), 9)] = a + y * self.weight[1] * unit, n + self.weight[y] * unit
        levels = [(a + 2 * (i + 0.5) / 10) / (n + 2) for i, (a, n) in enumerate(tenth)]
        self.levels = list(np.maximum.accumulate(levels))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """Probability, and its evidence: (doc_id, cosine, label) of the voters."""
        counts = self.words.counts(text)
        if not counts or self.index is None:
            return self.without, []
        vote, near = self.vote(self.vector(counts))
        at = min(max(vote * 10 - 0.5, 0), 9)
        low = int(at)
        high = min(low + 1, 9)
        return float(self.levels[low] + (at - low) * (self.levels[high] - self.levels[low])), [(self.ids[i], s, self.labels[i]) for s, i in near]


def _doc_terms(batches):
    """(term, label, documents) of a few documents."""
    for batch in batches:
        seen: Counter = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_WORD.findall((text or "").lower()))
            seen.update((t, label) for t in {t for w in words for t in terms_of(w)})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "label", "n"])


def _contexts(terms: list[str]):
    """Different surroundings of each term, by label: a text and its copies give one."""

    def run(batches):
        words = Vocabulary(terms)
        for batch in batches:
            seen = set()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _WORD.findall((text or "").lower())
                for before, word, after in zip(["", *found], found, [*found[1:], ""]):
                    for t in words[word] if word[: BEGINNINGS[0]] in words.heads else ():
                        seen.add((t, label, zlib.crc32(f"{before} {after}".encode())))
            rows = list(zip(*seen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64())], names=["term", "label", "context"])

    return run


def _chosen(counts: DataFrame, base: float, looked_at: int, most: int) -> list:
    """Terms commoner among toxic examples than chance over all terms looked at allows, by the Chernoff bound, strongest first."""
    p = (F.col("toxic") / F.col("n")).cast("double")
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    strength = F.col("n") * (part(p, F.lit(base)) + part(1 - p, F.lit(1 - base)))
    strong = counts.withColumn("s", strength).where(p > base).where(F.col("s") >= math.log(looked_at) + DOUBT)
    return [r["term"] for r in strong.orderBy(F.desc("s"), "term").limit(most).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows outside the held-out fifth.

    1. At most EXAMPLES rows per class, by hash of the id, are the examples.
    2. Terms are chosen whose share of toxic examples exceeds the classes' by more
       than chance over all terms allows, in documents and in different
       surroundings, so that a copied text counts once; TERMS at most.
    3. Document frequencies of those terms are counted over all documents.
    4. The index and calibration are made from the examples' term counts.
    The sizes of all that reaches the driver follow EXAMPLES and TERMS alone.
    """
    docs = with_missing(docs, doc_id="long", text="string")
    known = with_missing(labels, doc_id="long", toxic="int").where("toxic in (0, 1) and doc_id is not null").where(F.pmod(crc_of_id(), F.lit(5)) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    if share is None:
        return Model([], [], 0, [], 0.0)
    h = F.xxhash64("doc_id")
    picks = [known.where(F.col("toxic") == y).orderBy(h, "doc_id").limit(EXAMPLES) for y in (0, 1)]
    picked = save(picks[0].union(picks[1]), "picked")
    examples = save(docs.join(F.broadcast(picked), "doc_id"), "examples")  # 2 * EXAMPLES rows of two numbers
    per_class = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, b = per_class.get(1, 0), per_class.get(0, 0)
    if not a or not b:
        return Model([], [], 0, [], float(share))
    base = a / (a + b)
    per_term = examples.select("text", "toxic").mapInArrow(_doc_terms, "term string, label int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum("n").alias("n")
    )
    per_term = save(per_term, "terms")
    looked_at = max(per_term.count(), 1)
    likely = _chosen(per_term, base, looked_at, 4 * TERMS)
    contexts = examples.select("text", "toxic").mapInArrow(_contexts(likely), "term int, label int, context long").distinct()
    contexts = contexts.groupBy("term").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("toxic"), F.count("*").alias("n"))
    terms = [likely[i] for i in _chosen(save(contexts, "contexts"), base, looked_at, TERMS)]
    words = Vocabulary(terms)

    def count(batches):
        seen: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                seen.update(words.counts(text).keys())
        seen[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    frequency = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}

    @F.pandas_udf("array<struct<t: int, c: int>>")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"t": t, "c": c} for t, c in sorted(words.counts(x).items())])

    rows = examples.select("doc_id", "toxic", counted("text").alias("counts")).orderBy("doc_id").collect()
    return Model(terms, [frequency.get(i, 0) for i in range(len(terms))], frequency.get(-1, 0), [({x["t"]: x["c"] for x in r["counts"]}, r["toxic"], r["doc_id"]) for r in rows], float(share))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, evidence (doc_id, cosine and label of the voting examples).

    Only the text enters a score. Texts with none of the chosen terms, empty and
    null ones too, get the smoothed toxic share of such examples. Without labels
    of both classes every score is the share of toxic labels. Repeated rows are
    scored each, repeated labels count once (toxic wins), rows without doc_id are
    not held out; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column(1).to_pylist():
                s, e = model.score(text)
                scores.append(s)
                evidence.append([dict(zip(("doc_id", "cosine", "label"), x)) for x in e])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, near)], names=["doc_id", "score", "evidence"])

    out = with_missing(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: bigint, cosine: double, label: int>>")
    return out.select("doc_id", F.coalesce(F.pmod(crc_of_id(), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs whose score is below 0.5, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = shared.value
        return texts.map(lambda x: model.score(x)[0])

    return docs.where(score("text") < 0.5)
