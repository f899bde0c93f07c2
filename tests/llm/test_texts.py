"""Operators on documents against plain versions, with nulls, empty and long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import automata, byte_bpe, near_dup, outliers, packing, pieces, secrets, toxicity
from tidemark.llm import lattice, lm
from tidemark.llm.hashing import shingles, word_hashes
from tidemark.llm.superminhash import signatures

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, n long, key string"


def _docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), 7, 8, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["".join(r.choices("abcdeé", k=r.randint(2, 6))) for _ in range(300)]
    out = [(i, " ".join(r.choices(words, k=r.randint(15, 90)))) for i in range(60)]
    base = out[0][1].split()
    for i in range(60, 100):  # near copies around the similarity asked for
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, " ".join(w)))
    out += [(100, None), (101, ""), (102, " \n\t"), (103, "One"), (104, "oNE"), (105, "one two"), (106, out[3][1]), (106, out[3][1]), (107, "word " * 30000), (108, "Zeile\x0bx\x85y\u2003z")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return _docs(spark, texts)


def _sets(text, k):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, texts, k, monkeypatch):
    monkeypatch.setattr(near_dup, "MEMBERS", 8)
    monkeypatch.setattr(near_dup, "SKETCHED", 16)
    sets = {}
    for i, t in texts:
        sets[i] = _sets(t, k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near_dup.near_duplicates(docs, k).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    kept = near_dup.one_of_each(docs, k)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if find(i) == i)


def test_near_duplicates_of_nothing(spark, docs):
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in near_dup.near_duplicates(lone).collect()) == [(False, 3, True), (True, None, True)]


def _mixed_buckets(spark, buckets):
    members = spark.createDataFrame([(k, i, c) for k, rows in buckets.items() for i, c in rows], "key long, id long, comp long")
    return members, near_dup._mixed(members)


def test_strays_alone_meet_every_block_of_a_bucket(spark):
    rows = [(i, 0) for i in range(500)] + [(500 + i, 500 + i) for i in range(3)]
    members, mixed = _mixed_buckets(spark, {7: rows, 8: [(i, 0) for i in range(50)], 9: [(0, 0), (500, 500)]})
    got = near_dup._in_blocks(members, mixed, 10).collect()
    assert {r.key for r in got} == {7, 9}
    assert len(got) == 2 + 500 + 3 * (50 + 1)
    comp, met = dict(rows), {}
    for r in got:
        met.setdefault((r.key, r.lo, r.hi), []).append((r.id, r.side))
    pairs = [(min(a, b), max(a, b)) for (k, *_), block in met.items() if k == 7 for a, x in block for b, y in block if a < b and comp[a] != comp[b] and (x == 2 or x != y)]
    assert sorted(pairs) == sorted((a, b) for a in comp for b in comp if a < b and comp[a] != comp[b])


def test_buckets_of_one_component_are_dealt_once(spark):
    tight = {k: [(i, 0) for i in range(40)] + [(100 + i, 100 + i) for i in range(3)] for k in range(30)}
    loose = {50 + k: [(1000 + 4 * k + i, 1000) for i in range(4)] + [(2000 + k, 2000 + k)] for k in range(6)}  # together 6 strays would meet 30 members, not 5 each
    members, mixed = _mixed_buckets(spark, {**tight, **loose})
    got = [tuple(r) for r in near_dup._merged(members, mixed).collect()]
    assert len(got) == 43 + 6 * 5
    assert sorted((k, i) for k, i, _ in got) == sorted([(0, i) for i in [*range(40), 100, 101, 102]] + [(k, i) for k, rows in loose.items() for i, _ in rows])


def test_signatures_estimate_and_stop_early():
    a = shingles(word_hashes([" ".join(map(str, range(1000))).encode()])[0], 1)
    b = np.sort(np.concatenate([a[:889], shingles(word_hashes([b" ".join(b"x%d" % i for i in range(111))])[0], 1)]))
    s = signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 324)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.08
    alone = signatures(a, np.zeros(len(a), int), 1, 324)
    assert (alone[0] == s[0]).all()
    long = b"w" * 200_000 + b" " + b"ab " * 50_000
    assert len(word_hashes([long])[0]) == 50_001


def _base_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, texts):
    r = random.Random(1)
    more = [(1000 + i, " ".join(r.choice(["alpha", "beta", "gamma", "de", "epsilon"]) + str(r.randrange(90)) for _ in range(r.randint(40, 200)))) for i in range(120)]
    more += [(2000 + i, "\n".join(f"## {i} $$ {j} %% &&" for j in range(20))) for i in range(6)]
    more += [(3000, "a b c d e f g h i\n" * 4), (3001, "x\ny\nx\n\n" + "w " * 3)]
    docs = _docs(spark, [*texts, *more])
    got = outliers.quality_rules(docs).collect()
    every = {}
    for i, t in [*texts, *more]:
        every[i] = t
    assert len(got) == len(texts) + len(more)
    for x in got:
        n, chars, symbols, lines, repeated = _base_counts(every[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, chars, symbols, lines, repeated), x.doc_id
        assert x.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert not (x.kept and x.base_failed)
        if 1000 <= x.doc_id < 2000:
            assert x.kept
        if 2000 <= x.doc_id < 3000:
            assert not x.kept
    kept = outliers.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x.doc_id for x in got if x.kept)
    assert outliers.quality_rules(docs.limit(0)).count() == 0


def test_determinant_is_least_over_halves(spark):
    """Estimates ignore a cluster of a fifth of the rows, unlike the plain covariance."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, (400, 4)), r.normal(30, 0.1, (100, 4))])
    rows = spark.createDataFrame([("a", "b", *map(float, v)) for v in x], "g_lang string, g_source string, x0 double, x1 double, x2 double, x3 double")
    e = outliers.estimates(rows).first()
    assert all(abs(e[f"m{i}"]) < 0.4 for i in range(4)) and all(e[f"l{i}{i}"] < 2.5 for i in range(4))


def test_secrets(spark, docs):
    hexes = ["%040x" % random.Random(i).getrandbits(160) for i in range(80)]
    cases = [(i, f'é token = "{h}" and') for i, h in enumerate(hexes)]
    cases += [(200, "PassWord:abc123DEF456xyz secret=short token:tooShort"), (201, "xAKIA" + "AB12" * 4 + " AKIAAB12"), (202, "password=token:abcdefghijklmnop"), (203, None), (204, "ſecret=abcdefghijkl12"), (205, "dead" * 4 + "g" + "beef" * 3)]
    cases += [(300 + i, f"see www.host{i}.example.org/page-{i} or 10.0.{i}.44 thanks") for i in range(60)]
    cases += [(400, "left over 9f8e7d6c5b4a3f2 here")]
    got = {r.doc_id: r for r in secrets.secret_scan(_docs(spark, cases)).collect()}
    for i, t in cases:
        want = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(t or "") if len(m[2]) >= 12]
        want += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
        want += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 16]
        want.sort(key=lambda x: (x[0], secrets.KINDS.index(x[2])))
        assert [(s.start, s.end, s.kind) for s in got[i].base] == want, t
    assert not any(got[i].added for i in range(300, 360))
    clean = {r.doc_id: r for r in secrets.without_secrets(_docs(spark, cases)).collect()}
    assert hexes[0] not in clean[0].text and clean[0].n_chars == len(clean[0].text) and clean[203].text is None
    assert clean[300].text == dict(cases)[300]
    assert secrets.secret_scan(docs.limit(0)).count() == 0


def test_automaton_merges_and_prefers_its_format():
    r = random.Random(2)
    a = automata.Automaton(["".join(r.choices("0123456789abcdef", k=20)) for _ in range(300)])
    b = automata.Automaton([f"{r.randrange(256)}.{r.randrange(256)}.10.7" for _ in range(300)])
    assert a.states() < 60
    assert a.score("00ff00ff00ff00ff00ff") > b.score("00ff00ff00ff00ff00ff") + 10
    assert b.score("12.200.10.7") > a.score("12.200.10.7")


def test_toxicity(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = r.choices(words, k=30) + ([r.choice(["zounds", "zoundsing", "zoundsly"]) for _ in range(3)] if bad else [])
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs = _docs(spark, [*rows, (900, None), (901, ""), (902, "zoundsish"), (901, "")])
    known = spark.createDataFrame([*labels, (None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == 604 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    want = dict((i, t) for i, _, t in labels)
    out = [x for x in got if x.doc_id in want and x.held_out]
    assert out and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.predicted != want[x.doc_id] for x in out) <= len(out) * 0.02
    by = {x.doc_id: x for x in got}
    assert by[902].predicted == 1 and by[902].evidence and by[900].predicted == by[901].predicted == 0
    left = toxicity.without_toxic(docs, known)
    assert left.columns == docs.columns and left.count() == sum(x.predicted == 0 for x in got)
    assert {x.score for x in toxicity.toxicity(docs, known.limit(0)).collect()} == {0.0}


def test_block_max_index_is_exact():
    r = random.Random(6)
    vectors = []
    for _ in range(500):
        v = {r.randrange(80): r.random() + 0.1 for _ in range(r.randint(1, 9))}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in v.items()})
    index = toxicity.BlockMaxIndex(vectors, 80)
    for q in vectors[:40]:
        every = sorted(((sum(q[t] * v.get(t, 0.0) for t in sorted(q)), i) for i, v in enumerate(vectors)), key=lambda x: (-round(x[0], 12), x[1]))
        got = index.nearest(q, 15)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in every[: len(got)]] and len(got) >= min(15, sum(s > 0 for s, _ in every))


def test_token_ids_are_the_tokenizers(texts):
    from tokenizers import Tokenizer

    vocabulary, ranks = packing.tokenizer_files()
    full, fast = Tokenizer.from_file(vocabulary), byte_bpe.ByteBPE.at(vocabulary, ranks)
    odd = ["", " ", "a  b", "a \n b\n", "x<|endoftext|>y", "don't  stop ", "1²Ⅷ３ é\u0301", "\ttab x\x1c y\x85 z", "日本 語"]
    for t in [*odd, *(t or "" for _, t in texts)]:
        assert np.frombuffer(fast.ids(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.tokenizer_files()[0])
    rows = packing.placements(docs, 256).collect()
    want = Counter()
    for i, t in texts:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 2]
        cut = (len(ids) - 1) % 256 + 1
        at = [0, *range(cut, len(ids) + 1, 256)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert held.get(r.sequence_id, 0) == r.offset
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 256 and len(held) <= 1.05 * sum(r.length for r in rows) / 256
    assert packing.placements(docs.limit(0)).count() == 0


def test_minimum_bin_slack_packs_everything():
    r = random.Random(8)
    for _ in range(20):
        counts = {n: r.randint(1, 50) for n in r.sample(range(1, 101), 12)}
        left = Counter(counts)
        bins = 0
        for pattern, times in packing.minimum_bin_slack(counts, 100):
            assert sum(n * k for n, k in pattern.items()) <= 100
            left.subtract({n: k * times for n, k in pattern.items()})
            bins += times
        assert not any(left.values()) and bins >= -(-sum(n * c for n, c in counts.items()) // 100)


def test_lattice_scores(spark, texts, docs):
    got = lm.language_scores(docs)
    rows = got.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in texts]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm.language_scores(docs.limit(0)).count() == 0


def test_forward_sums_all_segmentations():
    vocabulary = lattice.Pieces(["a", "b", "ab", "ba", "aba"], [0.0] * 5, list(range(256)), list(range(5)), -9.0)
    scores = np.log([0.3, 0.2, 0.25, 0.15, 0.1])
    weight = dict(zip(vocabulary.pieces, np.exp(scores)))

    def every(x):
        return 1.0 if not x else sum(weight.get(x[:n], 0.0) * every(x[n:]) for n in range(1, 4) if len(x) >= n)

    words = ["a", "ab", "abab", "babaab", ""]
    chars, lengths = lattice.matrix(words)
    _, s = lattice.arcs(vocabulary, chars, scores, None)
    a, b = lattice.forward(s), lattice.backward(s, lengths)
    for i, w in enumerate(words):
        assert math.isclose(math.exp(a[i, lengths[i]]), every(w)) and math.isclose(a[i, lengths[i]], b[i, 0], abs_tol=1e-9)


def test_pieces_of_giant_texts(spark, docs, texts, monkeypatch):
    whole = {(r.doc_id, r.text): (bytes(r.ids), r.score) for r in pieces.encode(docs).collect()}
    monkeypatch.setattr(pieces, "GIANT", 40)
    monkeypatch.setattr(pieces, "CHUNK", 32)
    monkeypatch.setattr(pieces, "GROUP", 3)
    small = docs.where("doc_id <> 107")
    cut = pieces.encode(small).withColumn("again", pieces.decode(F.col("ids"))).collect()
    assert len(cut) == len(texts) - 1
    for r in cut:
        assert (bytes(r.ids), r.score) == whole[r.doc_id, r.text] and r.again == r.text


def test_pieces_against_the_library(texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(lm.model_file(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    scores = {i: p.score for i, p in enumerate(model.pieces)}
    encoder = pieces.Encoder.at(lm.model_file())
    for t in ["the cat sat", "Hello wörld again", "some longer sentence of words"]:
        ids = np.frombuffer(encoder.encode([t])[0][0], "<u4").tolist()
        assert encoder.pieces and sum(scores[i] for i in ids) >= sum(scores[i] for i in library.encode(t)) and library.decode(ids) == t


def test_pieces_of_chunks_whose_entries_never_meet(monkeypatch):
    vocabulary = pieces.Pieces(["a", "b", "aaa", "ab", "bbbb", pieces.SPACE], [-1.0, -1.0, -1.5, -3.0, -2.0, -1.0], list(range(256)), list(range(6)), -20.0)
    texts = ["a" * 300, "ab" * 150 + "é", ("abb" + pieces.SPACE) * 70, "b" * 40]
    sizes = [300, 290, 280, 40]
    walked = []
    best = pieces.best_paths
    monkeypatch.setattr(pieces, "best_paths", lambda s, start=None: walked.append((0 if start is None else len(start)) * s.shape[1]) or best(s, start))
    got = pieces._matrices(vocabulary, texts, sizes)
    for t, size, m in zip(texts, sizes, got):
        s = pieces._arcs_of(vocabulary, [t], [size])[2]
        for entry in range(pieces.LONGEST):
            start = np.where(np.arange(pieces.LONGEST) == entry, 0.0, -np.inf)[None, :]
            assert m[entry].tolist() == pieces._beyond(best(s, start)[0], np.array([size]))[0].tolist()
    # entries that have met are not walked to the end
    walked.clear()
    pieces._matrices(vocabulary, texts[1:3] * 32, sizes[1:3] * 32)
    assert sum(walked) < 64 * pieces.LONGEST * 300 / 2


def test_units_that_came_again_stay_known(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_UNITS", 3)
    encoder = pieces.Encoder(lm.model_file())
    want = encoder.encode(["one two three four"])
    assert encoder.encode(["two five", "one two three four"])[1] == want[0]
    assert encoder.encode(["two"]) and set(encoder.ids) == {"two"}
    assert [n for _, n in pieces._together([1, 2, pieces.HELD, 3, *[0] * pieces.TEXTS])] == [2, 1, pieces.TEXTS, 1]


def test_units_of_texts_encoded_together_are_cut_once(monkeypatch):
    encoder, calls = pieces.Encoder(lm.model_file()), []
    arcs = pieces.arcs
    monkeypatch.setattr(pieces, "arcs", lambda p, chars, *more: calls.append(len(chars)) or arcs(p, chars, *more))
    texts = ["", " ", "wörld  the", " the cat", "cat ", "the\u2581cat", "\u2581", "the\ncat \n", "漢 \U0001f600 the"] + [f"the n{i % 7} cat" for i in range(3000)]
    got = encoder.encode(texts)
    assert sum(calls) < 40  # also where the texts are more than one batch that goes back
    alone = {t: pieces.Encoder(lm.model_file()).encode([t])[0] for t in set(texts)}
    assert got == [alone[t] for t in texts]
    assert [n for _, n in pieces._together([1000] * 3000)] == [3000]
    # a beginning is followed only while some piece begins with it
    vocabulary = pieces.Pieces(["a", "b", "ab", "abcd", "é"], [-1.0] * 5, list(range(256)), list(range(5)), -9.0)
    chars, _ = pieces.matrix(["abcdé", "b", "abab"])
    found = vocabulary.find(chars)
    want = {(0, 0, 0): 0, (0, 0, 1): 2, (0, 0, 3): 3, (0, 1, 0): 1, (0, 4, 0): 4, (1, 0, 0): 1, (2, 0, 0): 0, (2, 0, 1): 2, (2, 1, 0): 1, (2, 2, 0): 0, (2, 2, 1): 2, (2, 3, 0): 1}
    assert {tuple(map(int, x)): int(found[tuple(x)]) for x in np.argwhere(found >= 0)} == want
