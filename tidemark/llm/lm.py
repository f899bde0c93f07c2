"""Language-model scores: the marginal probability of a text over all segmentations into subword pieces."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_of_id, save, with_missing
from tidemark.llm.lattice import Pieces, arcs, backward, batches_by_length, forward, matrix

#: Words whose numbers every task holds, those of the highest counts; all others meet their numbers in a join.
COMMON = 200_000
#: Longest common word in bytes, and distinct words counted in a task before it hands them on.
SHORT, HELD = 64, 200_000
#: Rounds of re-estimating the vocabulary's scores, and the count added to every piece.
ROUNDS, ADDED = 2, 0.1
LOG10 = math.log(10)


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _count(batches):
    """(word, n, trained) per task; words are bytes, lower-cased; the end of a text is the empty word."""
    train, rest = Counter(), Counter()

    def out():
        words = list(train.keys() | rest.keys())
        trained = [train[w] for w in words]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([t + rest[w] for w, t in zip(words, trained)], pa.int64()), pa.array(trained, pa.int64())], names=["word", "n", "trained"])

    for batch in batches:
        for text, held in zip(batch.column(0).cast("binary").to_pylist(), batch.column(1).to_pylist()):
            words = (text or b"").lower().split()
            words.append(b"")
            (rest if held else train).update(words)
            if len(train) + len(rest) > HELD:
                yield out()
                train.clear()
                rest.clear()
    if train or rest:
        yield out()


def _expect(path: str, scores: np.ndarray, byte_cost: np.ndarray):
    """Expected uses of each piece over the distinct words of a task; bytes follow the pieces."""

    def run(batches):
        pieces = Pieces.of_model(path)
        uses = np.zeros(len(scores) + 256)
        for batch in batches:
            words = ["▁" + w.decode() for w in batch.column(0).to_pylist()]
            for at in batches_by_length(words):
                chars, lengths = matrix([words[i] for i in at])
                found, s = arcs(pieces, chars, scores, byte_cost)
                a, b = forward(s), backward(s, lengths)
                total = a[np.arange(len(at)), lengths]
                i, j, l = np.nonzero(np.isfinite(s))
                with np.errstate(invalid="ignore"):
                    w = np.exp(a[i, j] + s[i, j, l] + b[i, j + l + 1] - total[i])
                w = np.nan_to_num(w)
                f = found[i, j, l]
                uses[: len(scores)] += np.bincount(f[f >= 0], w[f >= 0], minlength=len(scores))
                for c, x in zip(chars[i[f < 0], j[f < 0]], w[f < 0]):
                    for byte in chr(c).encode():
                        uses[len(scores) + byte] += x
        some = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(uses[some])], names=["piece", "uses"])

    return run


def _word_scores(path: str, scores: np.ndarray, byte_cost: np.ndarray, discount: float, rest: float, tokens: int):
    """log10 probability of each word: its discounted share of the training tokens, and the share set free times its lattice."""

    def run(batches):
        pieces = Pieces.of_model(path)
        for batch in batches:
            raw = batch.column(0).to_pylist()
            words = ["▁" + w.decode() for w in raw]
            out = np.zeros(len(words))
            for at in batches_by_length(words):
                chars, lengths = matrix([words[i] for i in at])
                out[at] = forward(arcs(pieces, chars, scores, byte_cost)[1])[np.arange(len(at)), lengths] / LOG10
            own = np.maximum(np.array(batch.column(2).to_pylist(), float) - discount, 0.0) / max(tokens, 1)
            end = np.array([not w for w in raw])
            with np.errstate(divide="ignore"):
                out = np.logaddexp(np.log(own), np.where(end, -np.inf if own[end].any() else -math.log(tokens + 2), out * LOG10 + math.log(rest))) / LOG10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["word", "n", "trained", "logp"])

    return run


class SubwordModel:
    """The word table (word, n, trained, logp), the number of training tokens and of distinct ones."""

    def __init__(self, words: DataFrame, tokens: int, distinct: int):
        self.words, self.tokens, self.distinct = words, tokens, distinct


def fit(docs: DataFrame, path: str | None = None) -> SubwordModel:
    """Word counts of all documents, and log probabilities learnt from those not held out.

    The vocabulary and its order of scores are the file's; the weights start as
    1 / (1 - score) and are re-estimated ROUNDS times from the expected uses of
    each piece over all segmentations of all distinct training words. Per-piece
    sums, as many as the vocabulary has pieces, are all that reaches the driver.

    Every word's lattice holds one more way besides its segmentations: the whole
    word with its training count, less a discount. What the discounts set free is
    what all segmentations share, so probabilities of words and end sum to one.
    """
    path = path or model_file()
    pieces = Pieces.of_model(path)
    words = docs.select("text", "held_out").mapInArrow(_count, "word binary, n long, trained long")
    words = save(words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained")), "words")
    seen = words.where("trained > 0")
    once, twice = (F.sum(F.when(F.col("trained") == i, 1)) for i in (1, 2))
    tokens, distinct, n1, n2 = (x or 0 for x in seen.agg(F.sum("trained"), F.count("*"), once, twice).first())
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    rest = discount * distinct / tokens if tokens else 1.0
    weight = np.concatenate([1 / (1 - pieces.scores), np.full(256, 1e-6)])
    for k in range(ROUNDS + 1):
        logs = np.log(weight / weight.sum())
        scores, byte_cost = logs[:-256], logs[-256:]
        if k == ROUNDS:
            break
        uses = seen.where(F.length("word") > 0).select("word").mapInArrow(_expect(path, scores, byte_cost), "piece int, uses double")
        weight = np.full(len(weight), ADDED)
        for r in uses.groupBy("piece").agg(F.sum("uses").alias("uses")).orderBy("piece").collect():
            weight[r["piece"]] += r["uses"]
    scored = words.mapInArrow(_word_scores(path, scores, byte_cost, discount, rest, tokens), "word binary, n long, trained long, logp double")
    return SubwordModel(save(scored, "word_scores"), tokens, distinct)


def _score(shared):
    """A row per document with the sums over its common words, then a row per other word."""
    schema = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("logp", pa.float64()), ("word", pa.binary()), ("times", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        number, sums = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc_id, text, held in zip(part.column(0).to_pylist(), part.column(1).cast("binary").to_pylist(), part.column(2).to_pylist()):
                    words = (text or b"").lower().split()
                    words.append(b"")
                    found = [number.get(w, -1) for w in words]
                    places = np.array(found)
                    known, base, logp = sums[places[places >= 0]].sum(0)
                    rows.append((row, doc_id, held, len(words), int(known), base, logp, None, None))
                    other = Counter(w for w, i in zip(words, found) if i < 0)
                    rows += [(row, None, None, None, None, None, None, w, n) for w, n in other.items()]
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def language_scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held out are documents whose crc32 of the id modulo 7 is 2; rows without
    doc_id are not. Null text is empty: its end alone is scored. A text's score is
    the log10 probability of its words, each over all segmentations, and its end.
    Repeated rows count and are scored each; other columns are ignored.

    Sums over common words, of a bounded number, are taken where the text is read;
    every other word is counted per document, meets its numbers in a join by word,
    and its sums come back by document. No word is left out.
    """
    spark = docs.sparkSession
    d = with_missing(docs, doc_id="long", text="string").withColumn("held_out", F.coalesce(F.pmod(crc_of_id(), F.lit(7)) == 2, F.lit(False)))
    model = fit(d, path)
    base = F.log10(F.col("trained") + 1.0)
    common = model.words.where(F.length("word") <= SHORT).orderBy(F.desc("n"), "word").limit(COMMON).select("word", (F.col("trained") > 0).cast("double").alias("k"), base.alias("b"), "logp").toPandas()
    numbers = {bytes(w): i for i, w in enumerate(common["word"])}
    shared = spark.sparkContext.broadcast((numbers, common[["k", "b", "logp"]].to_numpy(float).reshape(-1, 3)))
    rows = save(d.select("doc_id", "text", "held_out").mapInArrow(_score(shared), "doc long, doc_id long, held_out boolean, n_tokens long, known long, base double, logp double, word binary, times long"), "scored")
    times = F.col("times")
    other = rows.where("word is not null").select("doc", "word", "times").join(model.words.select("word", "trained", F.col("logp").alias("p")), "word")
    other = other.groupBy("doc").agg(
        F.sum(F.when(F.col("trained") > 0, times).otherwise(0)).alias("k"), F.sum(times * base).alias("b"), F.sum(times * F.col("p")).alias("p")
    )
    n = F.lit(math.log10(model.tokens + model.distinct + 1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.where("word is null").join(other, "doc", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("k")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") - F.col("n_tokens") * n).alias("base_score"), (F.col("logp") + zero("p")).alias("score"),
    )
