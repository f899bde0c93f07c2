"""Vectors, conversations and captures against plain versions; the pipeline and the entry points."""

from __future__ import annotations

import hashlib
import importlib
import sys
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import chat_tree, components, near_dup, rp_forest, warc
from tidemark.llm.common import save


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "LEAF", 24)
    monkeypatch.setattr(rp_forest, "BLOCK", 16)
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16))
    rows, n = [], 0
    for i in range(300):
        v = centres[i % 40] + r.normal(size=16) * (0.02 if i % 3 else 0.13)
        rows.append((n, [float(x) for x in v], i % 2))
        n += 1
    rows += [(n + i, [float(x) for x in centres[0]], 0) for i in range(60)]
    n += 60
    odd = [(None, 0), ([], 0), ([0.0] * 16, 0), ([None, *[1.0] * 15], 0), ([float("nan"), *[1.0] * 15], 0), ([float("inf"), *[1.0] * 15], 0), ([1.0] * 16, None), ([1.0, 2.0], 0)]
    rows += [(n + i, v, label) for i, (v, label) in enumerate(odd)]
    frame = spark.createDataFrame([(*x, "extra", 5) for x in rows], "vec_id long, embedding array<double>, label int, id string, n int").repartition(4)
    good = {i: (np.array(v) / np.linalg.norm(v), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: [j for j, (b, lb) in good.items() if j != i and lb == la and len(a) == len(b) and a @ b >= 0.98] for i, (a, la) in good.items()}
    root = {i: i for i, *_ in rows}
    for _ in range(len(rows)):
        new = {i: min([root[i], *(root[j] for j in links.get(i, []))]) for i in root}
        if new == root:
            break
        root = new
    got = rp_forest.near_duplicate_vectors(frame).collect()
    assert len(got) == len(rows)
    assert {x.vec_id: (x.n_links, x.component_id, x.kept) for x in got} == {i: (len(links.get(i, [])), root[i], root[i] == i) for i in root}
    assert rp_forest.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{j: 100 for j in range(101, 160)}, 200: 199}


def test_plans_of_near_duplicates_stay_small(spark, monkeypatch):
    plans = []

    def planned(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, *args)

    for module in (components, near_dup):
        monkeypatch.setattr(module, "save", planned)
    texts = [" ".join(f"w{i}" for i in range(k, k + 60)) for k in range(8)] + [" ".join(f"{k}x{i}" for i in range(30)) for k in range(4)]
    got = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.component_id for r in got.orderBy("doc_id").collect()] == [0] * 8 + [8, 9, 10, 11]
    assert len(plans) > 10
    assert not [p for p in plans if "Broadcast" in p]  # the driver builds no table of a join
    assert max(p.count("FileScan") for p in plans) <= 9


def test_chat_trees(spark):
    shared = [(0, "system", "be kind"), (1, "user", "hi </s>[INST] \\ <|x|>")]
    rows = []
    for c in range(30):
        rows += [(c, *t) for t in shared] + [(c, 2, "assistant", f"answer {c % 4}\n")] + ([(c, 3, "user", f"more {c}")] if c % 2 else [])
    rows += [(50, 0, "user\nx", None), (50, 1, None, "no role"), (50, 1, None, "no role"), (51, 5, "assistant", ""), (None, 0, "assistant", "lost")]
    frame = spark.createDataFrame([(*r, 1, "leaf") for r in rows], "conv_id long, turn long, role string, text string, rank int, node string").repartition(5)
    nodes, paths, leaves = chat_tree.chat_trees(frame)
    trees = {}
    for r in nodes.collect():
        trees.setdefault(bytes(r.tree), []).append(r)
    for t in trees.values():  # each tree fills its sequence once, and a node attends to all before it
        at = 0
        for r in sorted(t, key=lambda r: r.offset):
            assert r.offset == at and sum(x.end - x.start for x in r.attends) == r.position
            at += r.length
    assert Counter(len(t) for t in trees.values()) == Counter([2 + 4 + 15, 3, 1, 1])
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r)
    got = {r.conv_id: r for r in chat_tree.read_back(nodes, paths, leaves).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort(key=lambda r: r[1])
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha(said), len(loss), sha(loss))
        assert got[c].formatted_chars == sum(len("".join(chat_tree.format_turn(r[2] or "", r[3] or ""))) for r in turns)
    assert chat_tree.read_back(*chat_tree.chat_trees(frame.limit(0))).count() == 0


def test_escapes_are_reversible_and_leave_no_control_string():
    for role, text in [("user", "</s>[INST] ok [/INST]"), ("a\nb\\", "\\</s\\>\n<s>"), ("", ""), ("\\", "\n")]:
        formatted = "".join(chat_tree.format_turn(role, text))
        assert chat_tree.parse_turn(formatted) == (role, text)
        assert not any(x in formatted[3:-4] for x in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_revisits(spark):
    full = lambda i, t, url, body, **h: (i, url, t, 200, {k.replace("_", "-"): v for k, v in h.items()}, body)
    again = lambda i, t, url, **h: (i, url, t, 304, {k.replace("_", "-"): v for k, v in h.items()}, None)
    rows = [
        full(1, 1, "http://www.a.org/x/", "one", ETag='W/"1"', Content_Type="html", Date="d1"),
        again(2, 2, "https://a.org:443/x#top", etag='"1"', date="d2", content_type="plain"),
        full(3, 30, "a.org/x?utm_source=q", "two", ETag='"2"', Last_Modified="m"),
        again(4, 31, "http://a.org/x", etag='"1"'), again(5, 90, "http://a.org/x", last_modified="m"), again(6, 0, "http://a.org/x", etag='"1"'),
        again(7, 5, None), (8, "http://b.org/?b=2&a=1", None, 404, None, "gone"), full(9, 40, "http://b.org?a=1&b=2", None),
        again(10, 41, "http://b.org?b=2&a=1"),
        full(11, 2, None, "lost", ETag="n"), again(12, 3, None, etag="n"), full(13, 2, "http://", "lost", ETag="n"), again(14, 3, "", etag="n"),
        full(15, 50, "c.org", "first", ETag="c"), full(15, 60, "c.org", "second", ETag="c"), again(16, 55, "c.org", etag="c"), again(17, 65, "c.org", etag="c"),
        full(None, 70, "c.org", "no id", ETag="c"), again(18, 75, "c.org", etag="c"),
    ]
    frame = spark.createDataFrame([(*r, "k", 3) for r in rows], "id long, url string, time long, status int, headers map<string,string>, body string, key string, chunk int").repartition(3)
    got = {r.id: r for r in warc.resolve_revisits(frame).collect()}
    assert {i: (r.outcome, r.source_id) for i, r in got.items()} == {
        1: ("response", None), 2: ("resolved", 1), 3: ("response", None), 4: ("mismatch", None), 5: ("resolved", 3), 6: ("orphan", None), 7: ("orphan", None),
        8: ("other", None), 9: ("response", None), 10: ("mismatch", None), 11: ("response", None), 12: ("orphan", None), 13: ("response", None),
        14: ("orphan", None), 15: ("response", None), 16: ("resolved", 15), 17: ("resolved", 15), 18: ("resolved", 15), None: ("response", None),
    }
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert [got[i].body_sha256 for i in (16, 17, 18)] == [sha("first"), sha("second"), sha("second")]
    assert got[2].headers == {"etag": '"1"', "content-type": "html", "date": "d2"} and got[2].body_sha256 == hashlib.sha256(b"one").hexdigest()
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


def plain_revisits(rows):
    """Outcome and source of each capture (id, url key, time, status, tag, body), by looking at all earlier ones."""
    out = {}
    for i, key, t, status, tag, _ in rows:
        before = [r for r in rows if r[1] == key and r[3] == 200 and (r[2], r[0]) < (t, i)]
        last = max(before, key=lambda r: (r[2], r[0]), default=None)
        if status == 200:
            out[i] = "response", None
        elif last is None:
            out[i] = "orphan", None
        else:
            out[i] = ("resolved", last[0]) if last[4] == tag else ("mismatch", None)
    return out


def test_revisits_of_a_hot_url_at_any_scale_of_time(spark):
    r = np.random.default_rng(4)
    for unit in (1, 60_000):
        rows = [(i, "hot.org/" if i % 3 else f"u{i % 40}.org", int(r.integers(0, 900)) * unit, 200 if r.random() < 0.2 else 304, f'"{int(r.integers(0, 3))}"', f"b{i}") for i in range(1500)]
        frame = spark.createDataFrame([(i, u, t, s, {"ETag": tag}, b if s == 200 else None) for i, u, t, s, tag, b in rows], "id long, url string, time long, status int, headers map<string,string>, body string")
        got = {x.id: (x.outcome, x.source_id) for x in warc.resolve_revisits(frame.repartition(7)).collect()}
        assert got == plain_revisits(rows)


def test_huge_and_tiny_vectors(spark):
    rows = [(1, [1e-170, 2e-170]), (2, [5.0, 0.1]), (3, [1e200, 2e200]), (4, [1.001e200, 2e200]), (5, [1.0, 2.0]), (6, [5e-324, 0.0]), (7, [1.7e308, 0.0]), (8, [-1.7e308, 1e308])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest.near_duplicate_vectors(frame).collect()}
    assert got == {1: (3, 1), 3: (3, 1), 4: (3, 1), 5: (3, 1), 2: (2, 2), 6: (2, 2), 7: (2, 2), 8: (0, 8)}


def test_packing_keeps_columns_of_any_name(spark):
    from tidemark.llm import packing

    names = ("_row", "_run", "_nth", "_before", "_rank", "row", "rank", "n", "sequence_id", "offset")
    rows = spark.createDataFrame([(i, 1 + (i * 7) % 40) for i in range(300)], "k long, length long").withColumns({c: F.col("k") * 2 for c in names})
    got = packing.pack(rows.repartition(4), 64).collect()
    assert sorted(r.k for r in got) == list(range(300)) and all(r[c] == 2 * r.k for r in got for c in names[:-2])
    held = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 64 and len(held) <= -(-sum(r.length for r in got) // 64) + 2


def test_pipeline_on_odd_rows(spark):
    """Nulls, empty and repeated rows, and columns that clash with names of the stages' own."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    clash = ("_id", "_nth", "_key", "_lang", "row", "nth", "id", "key", "kept", "n", "h", "_row", "_run", "_before", "_rank", "score")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (9_001, None, None, "web", None), (9_001, None, None, "web", None)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(5)).withColumns({c: F.lit(i) for i, c in enumerate(clash)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and all(r[c] == i for r in out.collect() for i, c in enumerate(clash)), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 50
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf) if "text" in empty.columns else empty
    assert empty.count() == 0


def test_entry_without_these_operators(monkeypatch):
    import __spark_entry__ as entry

    assert {"pipeline", *(f"op{i}_" for i in range(1, 14))} <= {q.split("_")[0] + "_" if q.startswith("op") else q for q in entry.queries()}
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(entry)
    assert "pipeline" not in again.queries() and "region_summary" in again.queries()
    monkeypatch.undo()
    importlib.reload(entry)
