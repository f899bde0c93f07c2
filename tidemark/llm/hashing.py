"""Vectorised 64-bit hashes of words and word shingles over UTF-8 buffers."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd base of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once; longer texts are cut at word ends.
WINDOW = 1 << 16

_WORD = np.ones(256, np.int8)
_WORD[[0x20, *range(0x09, 0x0E)]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(BASE))


class _Powers:
    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * WINDOW)
            cls.up = np.concatenate([[U(1)], np.cumprod(np.full(size - 1, BASE, U), dtype=U)])
            cls.down = np.concatenate([[U(1)], np.cumprod(np.full(size - 1, INVERSE, U), dtype=U)])
        return cls.up[:n], cls.down[:n]


def _window_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of a buffer's words."""
    a = np.frombuffer(buf, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = _WORD[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _Powers.of(len(a))
    total = np.zeros(len(a) + 1, U)
    np.cumsum(_BYTE[a] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U)), starts


def _long_text(text: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(text):
        end = min(at + WINDOW, len(text))
        while end < len(text) and _WORD[text[end]]:
            end += 1
        parts.append(_window_hashes(text[at:end])[0])
        at = end
    return np.concatenate(parts)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each lower-cased text a hash per word, in order.

    Short texts are hashed together; memory is bounded by the window and the
    longest word.
    """
    out, at = [], 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (held := held + len(texts[end]) + 1) <= WINDOW:
            end += 1
        if end == at:
            out.append(_long_text(texts[at]))
            at += 1
            continue
        h, starts = _window_hashes(b"\n".join(texts[at:end]))
        ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
        out += np.split(h, np.searchsorted(starts, ends[:-1]))
        at = end
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; fewer words are one shingle, no words none."""
    if not len(words):
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    h = words[:n] * U(2 * width + 1)
    for i in range(1, width):
        h = mix(h) + words[i : i + n]
    h = mix(h)
    h.sort()
    keep = np.empty(n, bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def texts_of(column) -> list[bytes]:
    """UTF-8 texts of an Arrow string column with A-Z lower-cased; null is empty."""
    return [(b or b"").lower() for b in column.cast("binary").to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
