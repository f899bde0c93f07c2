"""Secret scans: base patterns, and candidates that inferred credential grammars find likelier than plain strings."""

from __future__ import annotations

import heapq
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.automata import Automaton
from tidemark.llm.common import save, with_missing

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "grammar")

#: A candidate is a whole run of these characters, 12 or more with a digit and a letter.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Examples per kind that an automaton is fitted on: those of the smallest crc32, a bounded sample of the labelled strings.
EXAMPLES = 1500
#: A candidate is a secret if a credential automaton finds it likelier than the plain one by this many nats, and by this many per character.
MARGIN, PER_CHARACTER = 12.0, 0.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns by start, then kind as listed; a failing match still uses up its characters."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def _free_candidates(text: str, spans: list[tuple[int, int, str]]):
    for m in CANDIDATE.finditer(text):
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]) and not any(a < m.end() and m.start() < b for a, b, _ in spans):
            yield m


def _examples(batches):
    """Per task the strings of smallest hash of each kind; plain ones are candidates that no base pattern touches."""
    kept: dict[str, set] = {}

    def add(kind: str, value: str) -> None:
        group = kept.setdefault(kind, set())
        group.add((zlib.crc32(value.encode()), value[:256]))
        if len(group) > 8 * EXAMPLES:
            kept[kind] = set(heapq.nsmallest(EXAMPLES, group))

    for batch in batches:
        for text in batch.column(0).to_pylist():
            spans = base_spans(text or "")
            for a, b, kind in spans:
                value = text[a:b]
                add(kind, ASSIGN.match(value)[2] if kind == "assign" else value)
            for m in _free_candidates(text or "", spans):
                add("plain", m[0])
    rows = [(k, h, v) for k, group in kept.items() for h, v in heapq.nsmallest(EXAMPLES, group)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["kind", "hash", "value"]
    )


def grammars(docs: DataFrame) -> dict[str, Automaton]:
    """An automaton per kind of credential, labelled by the base patterns, and one of plain candidates.

    The whole table is scanned; EXAMPLES distinct strings of each kind, those of
    the smallest hash, reach the driver, and their automata are at most as large
    as their prefix tree. Of a string its first 256 characters are taken, and an
    automaton is fitted on the first 64 symbols: these bound the training sample,
    candidates are scored whole. Kinds without examples have none.
    """
    found = save(with_missing(docs, text="string").mapInArrow(_examples, "kind string, hash long, value string").distinct(), "examples")
    out = {}
    for kind in (*KINDS[:3], "plain"):
        rows = found.where(F.col("kind") == kind).orderBy("hash", "value").limit(EXAMPLES).collect()
        if rows:
            out[kind] = Automaton([r["value"] for r in rows])
    return out


def find(text: str, automata: dict[str, Automaton]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
    """Base spans, and further spans with their margin in nats."""
    spans, more = base_spans(text), []
    plain, secret = automata.get("plain"), [automata[k] for k in KINDS[:3] if k in automata]
    if plain and secret:
        for m in _free_candidates(text, spans):
            gain = max(a.score(m[0]) for a in secret) - plain.score(m[0])
            if gain >= max(MARGIN, PER_CHARACTER * len(m[0])):
                more.append((m.start(), m.end(), KINDS[3], gain))
    return spans, more


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, base (spans of the base patterns), added (spans that the grammars add, with their margin).

    Candidates for added spans are the strings that hold a digit and a letter; others
    can't be told from words and numbers by their form.
    Spans are in code points, end exclusive. Null texts are empty; empty texts
    have no spans; repeated rows are scanned each; other columns are ignored.
    """
    automata = grammars(docs)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    more = pa.struct([*span, pa.field("margin", pa.float64())])

    def run(batches):
        for batch in batches:
            base, added = [], []
            for text in batch.column(1).to_pylist():
                a, b = find(text or "", automata)
                base.append([dict(zip(("start", "end", "kind"), x)) for x in a])
                added.append([dict(zip(("start", "end", "kind", "margin"), x)) for x in b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(more))], names=["doc_id", "base", "added"])

    kinds = "start: bigint, end: bigint, kind: string"
    return with_missing(docs, doc_id="long", text="string").mapInArrow(run, f"doc_id long, base array<struct<{kinds}>>, added array<struct<{kinds}, margin: double>>")


def without_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by the mark in text; n_chars, if there, is the new length. Null text stays null."""
    automata = grammars(docs)

    @F.pandas_udf("string")
    def scrub(texts: pd.Series) -> pd.Series:
        def one(text):
            if not text:
                return text
            base, added = find(text, automata)
            out, at = [], 0
            for a, b, *_ in sorted([*base, *added]):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return texts.map(one)

    out = docs.withColumn("text", scrub("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
