"""The best few rows of many groups, kept while batches pass by."""

from __future__ import annotations

import numpy as np

#: Scores beyond 64 bits count as this, or its negative.
MOST = (1 << 63) - 1


class Best:
    """The k rows of the highest score per group, ties by smaller id, with further columns that ride along.

    Memory is k rows a group. ``floor`` is each group's k-th best score so far, or
    -MOST: rows below it can be left out before they are offered.
    """

    def __init__(self, groups: int, k: int, more: int = 0):
        self.k, self.floor = k, np.full(groups, -MOST, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(3 + more)]

    def offer(self, group, score, ident, *more) -> None:
        if not len(group):
            return
        rows = [np.concatenate([a, np.asarray(b, np.int64)]) for a, b in zip(self.rows, (group, score, ident, *more))]
        order = np.lexsort((rows[2], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        rank = np.arange(len(order)) - np.searchsorted(rows[0], rows[0], "left")
        full = rank == self.k - 1
        self.floor[rows[0][full]] = rows[1][full]
        self.rows = [r[rank < self.k] for r in rows]
