"""SuperMinHash signatures of many sets at once.

Every element walks its own random permutation of the m slots. Its j-th step
offers slot p[j] the value j + r with r in [0, 1), so values of one element are
correlated: no two of its offers fall into one slot, which lowers the variance
for small sets. After step j a set whose largest slot is below j + 1 is done;
no later step can change it.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.hashing import BASE, U, mix

#: Elements that walk at once; bounds the table of permutations.
BLOCK = 8192


def signatures(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """(n_sets, m) values; owner[i] is the set of elements[i], 0 to n_sets - 1. Slots of empty sets stay at the maximum."""
    sig = np.full(n_sets * m, np.iinfo(U).max, U)
    by_set = sig.reshape(n_sets, m)
    for at in range(0, len(elements), BLOCK):
        h, who = elements[at : at + BLOCK], owner[at : at + BLOCK].astype(np.int64)
        perm = np.tile(np.arange(m, dtype=np.uint16), (len(h), 1))
        row = np.arange(len(h))
        sets = np.unique(who)
        for j in range(m):
            x = mix(h[row] + U((j + 1) * BASE & 0xFFFFFFFFFFFFFFFF))
            k = j + (((x & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)
            slot = perm[row, k]
            perm[row, k] = perm[row, j]
            np.minimum.at(sig, who[row] * m + slot, (x >> U(32)) | U(j << 32))
            open_sets = by_set[sets].max(1) >= U((j + 1) << 32)
            if not open_sets.all():
                sets = sets[open_sets]
                if not len(sets):
                    break
                still = np.zeros(n_sets, bool)
                still[sets] = True
                row = row[still[who[row]]]
    return by_set


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of the given number of rows; the band's number is part of it."""
    n, m = sig.shape
    out = np.empty((n, m // rows), U)
    for b in range(m // rows):
        acc = np.full(n, b + 1, U)
        for i in range(rows):
            acc = mix(acc * U(BASE) + sig[:, b * rows + i])
        out[:, b] = acc
    return out
