"""License scans, hard negatives and ranked search against plain versions, and on odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bag_search, hard_negatives, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- licenses --------------------------------------------------------------------------------------


def plain_scan(text, phrases, notices):
    words = WORD.findall(fold(text))
    places = [
        (label, i, i + k) for label, p in phrases.items() if (k := len(q := WORD.findall(fold(p)))) for i in range(len(words) - k + 1) if words[i : i + k] == q
    ]
    blocks = []
    for label, percent, notice in notices:
        own = WORD.findall(fold(notice))
        step = licenses.LEAST_STEP
        while step < len(own):
            step *= 2
        for at in range(0, len(words), step):
            part = words[at : at + 2 * step]
            held = len(set(part) & set(own))
            if own and 100 * held >= percent * len(set(own)):
                blocks.append((label, at, at + len(part), held / len(set(own))))
    return len(words), sorted(places, key=lambda p: (p[1], p[0])), sorted(blocks, key=lambda b: (b[1], b[0]))


@pytest.fixture(scope="module")
def license_texts():
    r = random.Random(7)
    some = "der mit und the of to license under apache version 2 0 cc by nc été ñandú software copy".split()
    texts = [None, "", " \n--", "under the MIT license", "Under-the_MIT\tLicense under the mit license", "under the mit", " under the mit license", "CC-BY-NC CC BY NC"]
    for label, _, notice in licenses.NOTICES:
        words = notice.split()
        for drop in (0, 1, len(words) // 6, len(words) // 3):
            kept = [w for i, w in enumerate(words) if i not in r.sample(range(len(words)), drop)]
            texts.append(" ".join(r.choices(some, k=r.randrange(40)) + kept + r.choices(some, k=r.randrange(40))))
    texts += [" ".join(r.choices(some, k=r.choice([5, 30, 300]))) for _ in range(80)]
    texts.append(" ".join(r.choices(some, k=60_000)) + " released under the MIT license")
    return texts + [texts[3]] * 5


def test_license_scan(spark, license_texts):
    phrases = {**licenses.PHRASES, "twice": "by by", "none": "..."}
    notices = [*licenses.NOTICES, ("few", 50, "cc by nc 2"), ("none", 80, "--")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(license_texts)], "doc_id long, text string, words string, places int").repartition(5)
    got = {r.doc_id: (r.n_words, [tuple(p) for p in r.places], [tuple(b) for b in r.blocks]) for r in licenses.license_scan(frame, phrases, notices).collect()}
    for i, text in enumerate(license_texts):
        want = plain_scan(text, phrases, notices)
        assert got[i][0] == want[0] and sorted(got[i][1]) == sorted(want[1]), i
        assert sorted(got[i][2]) == sorted(want[2]), i
    assert any(g[2] for g in got.values()) and any(g[1] for g in got.values())


def test_license_scan_on_odd_tables(spark):
    frame = spark.createDataFrame([(None, "under the mit license"), (1, None), (1, "cc by nc"), (1, "cc by nc")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, len(r.places)) for r in licenses.license_scan(frame).collect()), key=str)
    assert got == [(1, 0, 0), (1, 3, 1), (1, 3, 1), (None, 4, 1)]
    assert licenses.license_scan(frame.limit(0)).count() == 0
    assert licenses.license_scan(frame.select("doc_id")).where("n_words > 0").count() == 0
    assert licenses.license_scan(frame, {}, []).where("size(places) + size(blocks) > 0").count() == 0


# --- hard negatives --------------------------------------------------------------------------------


def whole(x):
    return math.floor(256 * x) if abs(x) < 1 << 60 else 256 * int(x)


def plain_negatives(rows, every=100, k=5):
    cap = (1 << 63) - 1
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = min(good.get(i, (label, v)), (label, v))
    held = {i: (label, [whole(x) for x in v]) for i, (label, v) in good.items()}
    out = set()
    for a, (label, v) in held.items():
        if a % every:
            continue
        score = {i: max(-cap, min(cap, sum(x * y for x, y in zip(v, w)))) for i, (_, w) in held.items() if i != a and len(w) == len(v)}
        best = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:k]
        for p in best(i for i in score if held[i][0] == label):
            fit = [i for i in score if held[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(best(fit))}
    return out


def found(frame, **more):
    return [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.hard_negatives(frame, **more).collect()]


SCHEMA = "vec_id long, label string, embedding array<double>, v string, score int"


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK", 60)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16)) * np.linspace(1, 0.05, 16)
    rows = [(i, str(i % 4), [float(x) for x in centres[i % 12] + r.normal(size=16) * r.choice([0.02, 0.2, 1.0])]) for i in range(900)]
    rows += [(900 + i, str(i % 3), [0.5] * 16) for i in range(120)]  # ties
    odd = [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [-1.0, 0.25], [1e-300] * 16, [1e300] * 16, [3e8, -3e8] * 8, [1e17] * 16]
    n = len(rows)
    rows += [(n + i, str(i % 2), v) for i, v in enumerate(odd)] + [(1300 + 100 * i, str(i % 3), v) for i, v in enumerate(odd)]
    rows += [(n + 50 + i, None, [1.0] * 16) for i in range(3)] + [(None, "1", [1.0] * 16), rows[5], (6, "9", [0.1] * 16), (100, "0", [0.2] * 16)]
    frame = spark.createDataFrame([(*x, "v", 1) for x in rows], SCHEMA).repartition(5)
    got = found(frame)
    assert len(got) == len(set(got)) and set(got) == plain_negatives(rows) and len(got) > 150


def test_hard_negatives_of_few_rows(spark):
    frame = spark.createDataFrame([(*x, "v", 1) for x in [(100, "a", [1.0]), (1, "a", [1.0]), (2, "b", [0.9]), (3, "b", [0.7]), (4, "b", [1.1])]], SCHEMA)
    assert found(frame) == [(100, 1, 1, 2, 65536, 58880)]
    assert found(frame, is_anchor=F.col("vec_id") == 99) == [] and found(frame.limit(0)) == [] and found(frame.where("vec_id <> 100")) == []


def test_threshold_join_loses_nothing():
    r = np.random.default_rng(5)
    for size in (0, 1, 3, 16, 64):
        q = np.floor(256 * r.normal(size=(9, size)) * np.linspace(1, 0.1, size))
        x = np.floor(256 * r.normal(size=(300, size)) * np.linspace(1, 0.1, size))
        for share in (-1.0, 0.0, 0.2, 0.6):
            least = share * (q * q).sum(1)
            a, b, s = hard_negatives.threshold_join(q, x, least)
            want = {(i, j): int(p) for (i, j), p in np.ndenumerate(q @ x.T) if p >= least[i]}
            assert dict(zip(zip(a.tolist(), b.tolist()), s.tolist())) == want


# --- ranked search ---------------------------------------------------------------------------------


def plain_search(docs, items, k=20):
    words = [(i, WORD.findall(fold(t))) for i, t in docs]
    some = [w for _, w in words if w]
    n_docs, n_terms, df = len(some), sum(map(len, some)), Counter(t for w in some for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    texts = {}
    for i, t in items:
        if i is not None:
            texts[i] = min((x for x in (texts.get(i), t) if x is not None), default=None)
    out = []
    for item, text in texts.items():
        want, scored = WORD.findall(fold(text)), []
        for doc, w in words:
            tf, m = Counter(w), w and 75 + 25 * len(w) * n_docs // n_terms
            s = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in want if tf[t])
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(item, n + 1, doc, -s) for n, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1, 3])
def test_ranked_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(bag_search, "ITEMS", 12 if blocks == 1 else 5)
    monkeypatch.setattr(bag_search, "CELLS", 4096)
    r = random.Random(11)
    terms = [f"w{i}" for i in range(60)] + ["été", "Über"]
    docs = [(i, " ".join(r.choices(terms, k=r.choice([1, 4, 9, 40])))) for i in range(400)]
    docs += [(1000 - i, "w1 w2, W2") for i in range(90)] + [(2000 + i, "w2 w1 filler w2") for i in range(5)] + [(3000 + i, "w2 w1 other w2") for i in range(30)]
    docs += [(5000, None), (5001, ""), (5002, "--"), (None, "w1 w2 w2"), (7, "w1 w2 w2"), (7, "w1 w2 w2"), (5003, "w3 " * 30_000), (5004, "unknown words only")]
    items = [(i, " ".join(r.choices(terms, k=8))) for i in range(10)] + [(10, "w1 w2 w2"), (11, None), (12, "absent"), (None, "w1"), (3, "a"), (13, "w3")]
    frame = spark.createDataFrame([(*d, 1, "h", "m") for d in docs], "doc_id long, text string, n int, h string, m string").repartition(6)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, rank int")
    got = [tuple(x) for x in bag_search.ranked_search(frame, asked).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == plain_search(docs, items)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert bag_search.ranked_search(docs.limit(0), items).count() == 0
    assert bag_search.ranked_search(docs, items.limit(0)).count() == 0
    assert bag_search.ranked_search(docs.where("text = ''"), items).count() == 0
    assert [tuple(r) for r in bag_search.ranked_search(docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // 2200))]
