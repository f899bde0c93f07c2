"""Segmentation lattices of many strings at once over a fixed vocabulary of pieces."""

from __future__ import annotations

import numpy as np

from tidemark.llm.hashing import BASE, U, mix

#: Pieces are at most this long.
LONGEST = 16
_BITS = 20
_PIECE, _PREFIX = 1, 2


class Pieces:
    """Pieces with scores, looked up by the hash of their code points; unknown characters fall back to their bytes."""

    _open: dict[str, Pieces] = {}

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], ids: list[int], unknown: float):
        self.pieces, self.byte_ids, self.unknown = pieces, np.array(byte_ids), unknown
        self.ids = np.array(ids)
        keys, prefixes = self._hashes(pieces)
        order = np.argsort(keys)
        self._keys, self._at = np.append(keys[order], U(0)), np.append(order, -1).astype(np.int32)
        top = (keys[order] >> U(64 - _BITS)).astype(np.int64)
        self._first = np.full(1 << _BITS, -1, np.int32)  # of the keys with these leading bits
        self._first[top[::-1]] = np.arange(len(top) - 1, -1, -1)
        self._kind = (self._first >= 0).astype(np.uint8)  # _PIECE: a piece has these leading bits, _PREFIX: a longer piece begins so
        self._kind[(prefixes >> U(64 - _BITS)).astype(np.int64)] |= _PREFIX
        self._alike = int(np.bincount(top).max()) if len(top) else 0
        self.scores = np.array(scores, float)

    @staticmethod
    def _hashes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pieces and of all their beginnings."""
        chars, lengths = matrix(pieces)
        h = np.zeros(len(pieces), U)
        prefixes = []
        for l in range(int(lengths.max(initial=0))):
            on = lengths > l
            prefixes.append(h[on])
            h[on] = mix(h[on] * U(BASE) + chars[on, l].astype(U) + U(1))
        return h, np.concatenate([np.empty(0, U), *prefixes[1:]])

    @classmethod
    def of_model(cls, path: str) -> Pieces:
        """The normal pieces of a SentencePiece file with its scores; each worker opens it once."""
        if path not in cls._open:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            n = sp.get_piece_size()
            normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and len(sp.id_to_piece(i)) <= LONGEST]
            bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
            scores = [sp.get_score(i) for i in normal]
            cls._open[path] = cls([sp.id_to_piece(i) for i in normal], scores, bytes_, normal, min(scores) - 10)
        return cls._open[path]

    def hits(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of an (n, L, LONGEST) table, in its flat order, and the number of the piece that begins at i and has l + 1
        characters. chars: (n, L), 0 beyond the end. Beginnings are followed while their characters begin some piece."""
        n, size = chars.shape
        wide = np.zeros((n, size + LONGEST), U)
        np.add(chars, 1, out=wide[:, :size], where=chars > 0, casting="unsafe")
        c = wide.ravel()
        at = np.flatnonzero(c)
        cell = (at - at // (size + LONGEST) * LONGEST) * LONGEST
        h = np.zeros(len(at), U)
        cells, numbers = [], []
        for l in range(min(LONGEST, size)):
            x = c[at + l]
            h = mix(h * U(BASE) + x)
            top = (h >> U(64 - _BITS)).view(np.int64)
            kind = np.where(x > 0, self._kind[top], 0)
            some = np.flatnonzero(kind & _PIECE)
            k, place = h[some], self._first[top[some]]
            for _ in range(1, self._alike):
                place += (self._keys[place] < k) & (place < len(self._keys) - 1)
            hit = self._keys[place] == k
            cells.append(cell[some[hit]] + l)
            numbers.append(self._at[place[hit]])
            on = np.flatnonzero(kind & _PREFIX)
            at, cell, h = at[on], cell[on], h[on]
        return np.concatenate([np.empty(0, np.int64), *cells]), np.concatenate([np.empty(0, np.int32), *numbers])

    def find(self, chars: np.ndarray) -> np.ndarray:
        """(n, L, LONGEST): number of the piece that begins at i and has l + 1 characters, or -1. chars: (n, L), 0 beyond the end."""
        return _table(chars, self.hits(chars), np.int32, -1)


def _table(chars: np.ndarray, hits: tuple[np.ndarray, np.ndarray], kind: type, none: float) -> np.ndarray:
    """(n, L, LONGEST) values of hits, none where there is no hit."""
    out = np.full((*chars.shape, LONGEST), none, kind)
    out.reshape(-1)[hits[0]] = hits[1]
    return out


def matrix(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings, one row each, and their lengths."""
    lengths = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(strings), int(lengths.max(initial=1)) or 1), np.uint32)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out, lengths


def batches_by_length(strings: list[str], cells: int = 1 << 14):
    """Index arrays of strings of like length, so that a batch's matrix has few empty cells."""
    lengths = np.array([len(s) for s in strings], np.int64)
    order = np.argsort(lengths, kind="stable")
    lengths, at = lengths[order], 0
    while at < len(order):
        ahead = lengths[at : at + cells]
        n = max(1, int(np.searchsorted(ahead * np.arange(1, len(ahead) + 1), cells, "right")))
        yield order[at : at + n]
        at += n


def arcs(pieces: Pieces, chars: np.ndarray, scores: np.ndarray, byte_cost: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pieces per arc and their scores, -inf where there is none. A character that is no piece gets the score of its
    bytes (byte_cost per byte) or the vocabulary's score of unknown characters."""
    cells, numbers = pieces.hits(chars)
    found = _table(chars, (cells, numbers), np.int32, -1)
    s = _table(chars, (cells, scores[numbers]), float, -np.inf)
    lone = (found[:, :, 0] < 0) & (chars > 0)
    if lone.any():
        if byte_cost is None:
            s[lone, 0] = pieces.unknown
        else:
            s[lone, 0] = [sum(byte_cost[b] for b in chr(c).encode()) for c in chars[lone]]
    return found, s


def log_sum(x: np.ndarray) -> np.ndarray:
    """Log of summed exponentials over the last axis."""
    top = x.max(-1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe[..., None]).sum(-1))


def forward(s: np.ndarray) -> np.ndarray:
    """(n, L + 1): log of the summed weight of all segmentations up to each position."""
    n, size, _ = s.shape
    a = np.full((n, size + 1), -np.inf)
    a[:, 0] = 0
    for i in range(1, size + 1):
        w = min(LONGEST, i)
        back = np.arange(1, w + 1)
        a[:, i] = log_sum(a[:, i - back] + s[:, i - back, back - 1])
    return a


def backward(s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(n, L + 1): the same from each position to the string's end."""
    n, size, _ = s.shape
    b = np.full((n, size + 1), -np.inf)
    b[np.arange(n), lengths] = 0
    for i in range(size - 1, -1, -1):
        w = min(LONGEST, size - i)
        ahead = np.arange(1, w + 1)
        b[:, i] = np.where(i == lengths, 0.0, log_sum(b[:, i + ahead] + s[:, i, ahead - 1]))
    return b
