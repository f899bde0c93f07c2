"""SentencePiece encoding and decoding: best segmentation by score, giant texts by a max-plus parallel scan."""

from __future__ import annotations

import re
from collections.abc import Container

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import save, with_missing
from tidemark.llm.lattice import LONGEST, Pieces, arcs, batches_by_length, matrix
from tidemark.llm.lm import model_file

SPACE = "▁"
#: A space begins a unit; no piece but runs of spaces has one elsewhere, so units are cut independently.
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Empty texts and those whose units begin with other than one mark.
_ODD = rf"\A\z|\A |  | \z|{SPACE}"
#: Texts longer than this many characters are giant; characters per chunk; chunks combined in one task.
GIANT, CHUNK, GROUP = 32_768, 2_048, 32
#: Chunks that a task looks at together: numpy's cost per step is shared by them. Chunks dealt to a task.
TOGETHER, DEALT = 64, 256
#: Texts and characters encoded together; texts of a batch that goes back to Spark; distinct units kept per Python worker.
TEXTS, HELD, GIVEN = 8_192, 1 << 22, 512
KEPT_UNITS = 60_000
NEVER = -np.inf


def normalized(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def best_paths(s: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(best, back): best score of each position and the length of its last piece, the longest of equals.

    start (n * m, LONGEST), m rows per string: scores of paths whose first cut is
    that far into the string, in place of a cut at its beginning; such a path has back 0.
    """
    n, size, _ = s.shape
    m = 1 if start is None else len(start) // n
    n *= m
    best = np.full((n, size + 1), NEVER)
    back = np.zeros((n, size + 1), np.int16)
    best[:, 0] = 0 if start is None else start[:, 0]
    flat, rows = s.reshape(len(s), -1), np.arange(n)
    for i in range(1, size + 1):
        w = min(LONGEST, i)
        # arcs that end at i, the longest first: from i - w, i - w + 1 and so on
        arcs_here = flat[:, (i - w) * LONGEST + w - 1 : (i - 1) * LONGEST + 1 : LONGEST - 1]
        x = best[:, i - w : i] + (arcs_here if m == 1 else np.repeat(arcs_here, m, 0))
        k = x.argmax(1)
        best[:, i], back[:, i] = x[rows, k], w - k
        if start is not None and i < LONGEST:
            own = start[:, i] >= best[:, i]  # its last piece began before the string: longer than any other
            best[:, i] = np.where(own, start[:, i], best[:, i])
            back[:, i] = np.where(own & (start[:, i] > NEVER), 0, back[:, i])
    return best, back


def _walk(back: list[int], end: int, known: Container[int] = ()) -> tuple[list[int], int]:
    """Beginnings of the pieces of the path that ends at end, last first, and where it begins or first meets a known cut."""
    out = []
    while back[end] and end not in known:
        end -= back[end]
        out.append(end)
    return out, end


def _ids(pieces: Pieces, found: np.ndarray, chars: np.ndarray, begins: list[int], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces that begin there, last first, the last one ending at end, and how many each has: characters that are no piece go by their bytes."""
    begin = np.array(begins[::-1], np.int64)
    k = found[begin, np.diff(begin, append=end) - 1]
    ids, width = np.where(k < 0, 0, pieces.ids[np.maximum(k, 0)]).astype("<u4"), np.ones(len(k), np.int64)
    lone = k < 0
    if lone.any():
        spelled = [pieces.byte_ids[list(chr(c).encode())] for c in chars[begin[lone]]]
        width[lone] = [len(x) for x in spelled]
        ids = np.repeat(ids, width)
        ids[np.repeat(lone, width)] = np.concatenate(spelled)
    return ids, width


def _walked(pieces: Pieces, found: np.ndarray, chars: np.ndarray, back: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Ids of the path of every row that ends at its end, all rows walked back together."""
    rows, at = np.arange(len(ends)), ends.astype(np.int64)
    steps, many = [], np.zeros(len(ends), np.int64)
    while True:
        n = back[rows, at].astype(np.int64)
        going = n > 0
        rows, at = rows[going], (at - n)[going]
        if not len(rows):
            break
        steps.append((rows, at, found[rows, at, n[going] - 1]))
        many[rows] = len(steps)
    if not steps:
        return [b""] * len(ends)
    # the k-th step back is the k-th piece from the row's last one
    after = np.cumsum(many)
    place = np.concatenate([after[x[0]] - k for k, x in enumerate(steps, 1)])
    row, begin, piece = (np.empty(len(place), np.int64) for _ in range(3))
    for out, x in zip((row, begin, piece), zip(*steps)):
        out[place] = np.concatenate(x)
    lone = piece < 0
    ids = np.where(lone, 0, pieces.ids[np.maximum(piece, 0)]).astype("<u4")
    if lone.any():  # characters that are no piece, by their bytes
        spelled = [pieces.byte_ids[list(chr(c).encode())] for c in chars[row[lone], begin[lone]]]
        width = np.ones(len(row), np.int64)
        width[lone] = [len(x) for x in spelled]
        ids, row = np.repeat(ids, width), np.repeat(row, width)
        ids[np.repeat(lone, width)] = np.concatenate(spelled)
    raw, cut = ids.tobytes(), 4 * np.searchsorted(row, np.arange(len(ends) + 1))
    return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _units_of(text: str) -> list[str]:
    return _UNIT.findall(normalized(text))


class Encoder:
    """Encodes texts together: each distinct unit of theirs is cut once, and its ids are dealt out by its number.

    The units that came most often are known to the next texts.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.pieces = Pieces.of_model(path)
        self.ids: dict[str, bytes] = {}
        self.scores: dict[str, float] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    @staticmethod
    def units(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Lists of the texts' units, those of single spaces only first, and the place of each text's list. A unit's one mark may be left out."""
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ").cast(pa.list_(pa.string()))
        if odd.true_count:
            others = pa.array([_units_of(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
            lists = pa.concat_arrays([lists, others])
        order = pc.sort_indices(odd.cast(pa.int8()))  # stable
        return lists, pc.sort_indices(order)

    def cut(self, units: list[str], counts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids and score of the best path of every unit; counts say how often it comes."""
        ids, scores = list(map(self.ids.get, units)), np.array([self.scores.get(u, 0.0) for u in units])
        new = [i for i, x in enumerate(ids) if x is None]
        marked = [u if u[0] == SPACE else SPACE + u for u in map(units.__getitem__, new)]
        for at in batches_by_length(marked):
            at = at.tolist()
            those = [new[i] for i in at]
            chars, lengths = matrix([marked[i] for i in at])
            found, s = arcs(self.pieces, chars, self.pieces.scores, None)
            best, back = best_paths(s)
            scores[those] = best[np.arange(len(at)), lengths]
            for i, x in zip(those, _walked(self.pieces, found, chars, back, lengths)):
                ids[i] = x
        kept = np.argsort(-counts, kind="stable")[:KEPT_UNITS].tolist()
        self.ids = {units[i]: ids[i] for i in kept}
        self.scores = dict(zip(self.ids, scores[kept].tolist()))
        return ids, scores

    def encode(self, texts: list[str]) -> list[tuple[bytes, float]]:
        return list(zip(*(x.to_pylist() for x in self.columns(pa.array(texts, pa.string())))))

    def columns(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids (binary) and score of every text; no text is null."""
        lists, place = self.units(texts)
        told = lists.flatten().dictionary_encode()
        number, bounds = told.indices, lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        number = number.to_numpy()
        ids, scores = self.cut(told.dictionary.to_pylist(), np.bincount(number, minlength=len(told.dictionary)))
        # the ids of all units in a row are those of all texts in a row
        dealt = pa.array(ids, pa.large_binary()).take(number)
        ends = np.frombuffer(dealt.buffers()[1], np.int64)[: len(dealt) + 1] if len(dealt) else np.zeros(1, np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends[bounds].tobytes()), dealt.buffers()[2]])
        each = scores[number].tolist()
        summed = [float(sum(each[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return whole.take(place).cast(pa.binary()), pa.array(summed, pa.float64()).take(place)


def _together(sizes: list[int]):
    """(first, number) of runs of texts of these sizes: TEXTS texts and, but for a longer one alone, HELD characters at most."""
    at = held = 0
    for i, size in enumerate(sizes):
        if i > at and (held + size > HELD or i - at == TEXTS):
            yield at, i - at
            at, held = i, 0
        held += size
    if sizes:
        yield at, len(sizes) - at


def _arcs_of(pieces: Pieces, texts: list[str], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, pieces and scores of chunks, over the arcs that begin in their first size characters."""
    chars, _ = matrix(texts)
    found, s = arcs(pieces, chars, pieces.scores, None)
    s[np.arange(s.shape[1])[None, :] >= np.array(sizes)[:, None]] = NEVER
    return chars, found, s


def _beyond(best: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores of cuts at the chunk's end and beyond."""
    at = sizes[:, None] + np.arange(LONGEST)[None, :]
    return np.where(at < best.shape[1], np.take_along_axis(best, np.minimum(at, best.shape[1] - 1), 1), NEVER)


def _few(batches):
    """Record batches of TOGETHER rows at most, chunks of like size together, so that few cells of a batch are empty."""
    for b in batches:
        b = b.take(pc.sort_indices(b.column("size")))
        for at in range(0, b.num_rows, TOGETHER):
            yield b.slice(at, TOGETHER)


def _split(giants: DataFrame) -> DataFrame:
    """Chunks of CHUNK characters, the last one longer, each with the next characters that its pieces may reach."""

    def run(batches):
        for b in batches:
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                whole = normalized(text)
                bounds = [*range(0, max(len(whole) - CHUNK, 1), CHUNK), len(whole)]
                for at in range(0, len(bounds) - 1, 64):
                    rows = [(doc, i, whole[bounds[i] : bounds[i + 1] + LONGEST - 1], bounds[i + 1] - bounds[i]) for i in range(at, min(at + 64, len(bounds) - 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int32()))], names=["doc", "chunk", "part", "size"])

    return giants.mapInArrow(run, "doc long, chunk long, part string, size int")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def _matrices(pieces: Pieces, texts: list[str], sizes: list[int]) -> np.ndarray:
    """(n, LONGEST, LONGEST): the matrix of each chunk.

    Paths that enter a chunk at different places soon meet. Once the last LONGEST scores from two entries differ
    by one number, all later ones do, so only the first entry is followed to the end; entries that have
    not met it are followed together over four times the length, as far as the whole chunk.
    """
    s = _arcs_of(pieces, texts, sizes)[2]
    sizes = np.array(sizes)
    first = _beyond(best_paths(s)[0], sizes)
    each = np.where(np.eye(LONGEST, dtype=bool), 0.0, NEVER)
    out = np.empty((len(texts), LONGEST, LONGEST))
    left, reach = np.arange(len(texts)), 4 * LONGEST
    while len(left):
        reach = min(reach, s.shape[1])
        met = np.zeros(len(left), bool)
        width = max(1, 16 * TOGETHER * LONGEST // reach)
        for at in range(0, len(left), width):
            some = left[at : at + width]
            best = best_paths(s[some, :reach], np.tile(each, (len(some), 1)))[0]
            if reach == s.shape[1]:
                out[some] = _beyond(best, np.repeat(sizes[some], LONGEST)).reshape(-1, LONGEST, LONGEST)
                met[at : at + width] = True
                continue
            last = best[:, -LONGEST:].reshape(len(some), LONGEST, LONGEST)
            known = np.isfinite(last).all((1, 2))
            ahead = np.where(known[:, None, None], last, 0.0)
            ahead = ahead - ahead[:, :1]
            same = known & (ahead == ahead[:, :, :1]).all((1, 2))
            out[some[same]] = first[some[same], None, :] + ahead[same, :, :1]
            met[at : at + width] = same
        left, reach = left[~met], 4 * reach
    return out


def _transfer(path: str):
    """Per chunk the matrix from its first cut to the first cut at or beyond its end."""

    def run(batches):
        pieces = Pieces.of_model(path)
        for b in _few(batches):
            out = [m.tobytes() for m in _matrices(pieces, b.column("part").to_pylist(), b.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("chunk"), pa.array(out, pa.binary())], names=["doc", "chunk", "m"])

    return run


def _square(raw) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(LONGEST, LONGEST)


def _product(group: int):
    """One matrix for a group of consecutive chunks."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        m = np.where(np.eye(LONGEST, dtype=bool), 0.0, NEVER)
        for raw in p.sort_values("chunk").m:
            m = times(m, _square(raw))
        return pd.DataFrame({"doc": [p.doc.iloc[0]], "chunk": [p.chunk.min() // group], "m": [m.tobytes()]})

    return run


def _starts(given: bool):
    """Vectors before each element of a group, from the vector before the group."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("chunk")
        v = np.frombuffer(p.before.iloc[0], "<f8") if given else np.where(np.arange(LONGEST) == 0, 0.0, NEVER)
        out = []
        for raw in p.m:
            out.append(v.tobytes())
            v = times(v[None, :], _square(raw))[0]
        return pd.DataFrame({"doc": p.doc, "chunk": p.chunk, "before": out})

    return run


def _prefixes(m: DataFrame) -> DataFrame:
    """(doc, chunk, before): exclusive max-plus scan, by groups of GROUP matrices, then the groups' products in the same way."""
    shape = "doc long, chunk long, before binary"
    if (m.agg(F.max("chunk")).first()[0] or 0) < GROUP:
        return m.groupBy("doc").applyInPandas(_starts(False), shape)
    grouped = m.withColumn("g", F.floor(F.col("chunk") / GROUP).cast("long"))
    products = save(grouped.groupBy("doc", "g").applyInPandas(_product(GROUP), "doc long, chunk long, m binary"), "products")
    before = _prefixes(products).withColumnRenamed("chunk", "g")
    return grouped.join(before, ["doc", "g"]).groupBy("doc", "g").applyInPandas(_starts(True), shape)


def _ways(pieces: Pieces, found: np.ndarray, chars: np.ndarray, back: list[int], ends: list[int | None]) -> tuple[list[int], bytes, list[int], list[bytes]]:
    """Per end: where its path enters the chunk, and its ids as so many of the common ones and its own after them.

    Paths to neighbouring ends soon meet, so the first one's ids serve all.
    """
    first = next(e for e in ends if e is not None)
    line, entry = _walk(back, first)
    ids, width = _ids(pieces, found, chars, line, first)
    known = dict(zip([*line[::-1], first], [0, *np.cumsum(width).tolist()]))
    enters, shared, own = [], [], []
    for end in ends:
        walk, at = ([], 0) if end is None else _walk(back, end, known)
        enters.append(entry if at in known else at)
        shared.append(known.get(at, 0))
        own.append(_ids(pieces, found, chars, walk, end)[0].tobytes() if walk else b"")
    return enters, ids.tobytes(), shared, own


_TRACE = "doc long, chunk long, enters array<int>, common binary, shared array<int>, own array<binary>, score double"


def _trace(path: str):
    """Per chunk, for each first cut beyond its end: where the best path that reaches it enters the chunk, and its ids."""

    def run(batches):
        pieces = Pieces.of_model(path)
        for b in _few(batches):
            sizes = b.column("size").to_pylist()
            start = np.stack([np.frombuffer(x, "<f8") for x in b.column("before").to_pylist()])
            chars, found, s = _arcs_of(pieces, b.column("part").to_pylist(), sizes)
            best, back = best_paths(s, start)
            beyond = _beyond(best, np.array(sizes))
            ends = [[size + k if v > NEVER else None for k, v in enumerate(row)] for size, row in zip(sizes, beyond)]
            ways = [_ways(pieces, found[i], chars[i], back[i].tolist(), ends[i]) for i in range(b.num_rows)]
            types = (pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()))
            columns = [pa.array(x, t) for x, t in zip(zip(*ways), types)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("chunk"), *columns, pa.array(beyond[:, 0])], names=["doc", "chunk", "enters", "common", "shared", "own", "score"])

    return run


def _leave(p: pd.DataFrame) -> pd.DataFrame:
    """From the end of a text back: where the best path leaves each chunk."""
    p = p.sort_values("chunk", ascending=False)
    at, out = 0, []
    for enters in p.enters:
        out.append(at)
        at = int(enters[at])
    return pd.DataFrame({"doc": p.doc, "chunk": p.chunk, "leave": out}).astype({"leave": "int32"})


def _joined(p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("chunk")
    return pd.DataFrame({"doc": [p.doc.iloc[0]], "ids": [b"".join(p.ids)], "score": [float(p.score.iloc[-1])]})


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, ids (32-bit little-endian piece ids), score: the best segmentation of every text by summed scores.

    Spaces become the mark of a word's beginning, and one is put before the text.
    A character that is no piece costs the least score less ten and is written as
    its bytes. Of equal segmentations the one of longer last pieces is taken.

    Texts of more than GIANT characters are cut into chunks. Each gives a matrix
    from where its first cut lies to where the first cut beyond its end lies; the
    matrices are scanned by max-plus products in groups; then every chunk, knowing
    the scores before it, traces its own part, and the parts that fit are joined.

    Null texts are empty and have no ids; repeated rows are encoded each; rows
    without doc_id stay; other columns are ignored. A literal mark (U+2581) in a text
    is encoded like a space, as the vocabulary knows no other, and read back as one.
    """
    path = path or model_file()
    d = with_missing(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    size = F.length("text")

    def short(batches):
        encoder = Encoder.at(path)
        for b in batches:
            for at, n in _together(pc.utf8_length(b.column(1)).to_pylist()):
                part = b.slice(at, n)
                got = encoder.columns(part.column(1))
                whole = pa.RecordBatch.from_arrays([*part.columns, *got], names=["doc_id", "text", "ids", "score"])
                for i in range(0, n, GIVEN):
                    yield whole.slice(i, GIVEN)
                del part, got, whole
            del b  # before the next one comes

    plain = d.where(size <= GIANT).mapInArrow(short, "doc_id long, text string, ids binary, score double")
    giants = save(d.where(size > GIANT).withColumn("doc", F.monotonically_increasing_id()), "giants")
    # dealt by their number, as a chunk costs the same whatever its bytes
    held = giants.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = _split(giants).repartition(held // (CHUNK * DEALT) + 1, "doc", "chunk")
    matrices = save(chunks.mapInArrow(_transfer(path), "doc long, chunk long, m binary"), "matrices")
    before = _prefixes(matrices)
    traced = save(chunks.join(before, ["doc", "chunk"]).mapInArrow(_trace(path), _TRACE), "traces")
    leaves = traced.select("doc", "chunk", "enters").groupBy("doc").applyInPandas(_leave, "doc long, chunk long, leave int")
    leave = F.col("leave")
    common = F.substring("common", F.lit(1), F.col("shared")[leave] * 4)
    parts = traced.join(leaves, ["doc", "chunk"]).select("doc", "chunk", F.concat(common, F.col("own")[leave]).alias("ids"), "score")
    whole = parts.groupBy("doc").applyInPandas(_joined, "doc long, ids binary, score double")
    return plain.unionByName(giants.join(whole, "doc").select("doc_id", "text", "ids", "score"))


def decode(ids, path: str | None = None):
    """Column of texts from a column of ids."""
    path = path or model_file()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        pieces = Pieces.of_model(path)
        if not hasattr(pieces, "written"):
            table = [b""] * (max(int(pieces.ids.max()), int(pieces.byte_ids.max())) + 1)
            for i, p in zip(pieces.ids, pieces.pieces):
                table[i] = p.replace(SPACE, " ").encode()
            for byte, i in enumerate(pieces.byte_ids):
                table[i] = bytes([byte])
            pieces.written = table
        read = pieces.written.__getitem__
        texts = (None if x is None else b"".join(map(read, np.frombuffer(x, "<u4").tolist())).decode(errors="replace")[1:] for x in (v.as_py() for v in column))
        return pa.array(texts, pa.string())

    return run(ids)
