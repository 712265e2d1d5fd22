"""Isolation forest in NumPy: path lengths over random splits.

Trees split a box: each split picks a column and a value uniformly within the
node's box, which starts as a range given (or that of the whole sample), so that empty space
beside the bulk is cut off early and rows there get short paths.  A leaf's path
length is its depth plus the usual expectation for the rows left in it.
"""

from __future__ import annotations

import numpy as np


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649015329) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    def __init__(self, trees: int = 100, sample: int = 256, depth: int = 10, seed: int = 7):
        self.trees, self.sample, self.depth, self.seed = trees, sample, depth, seed

    def fit(self, x: np.ndarray, box: np.ndarray | None = None) -> IsolationForest:
        """Trees over random rows of x, in the range of the rows of ``box`` where that is given."""
        rng = np.random.default_rng(self.seed)
        nodes: list[tuple[int, float, int, int, float]] = []
        self.roots = []
        whole = x if box is None else box
        low, high = whole.min(0), whole.max(0)
        size = min(self.sample, max(len(x) // 2, 1))
        self.unseen = np.ones((self.trees, len(x)), bool)

        def grow(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append((0, np.inf, me, me, depth + float(expected_path(len(rows)))))
            wide = np.flatnonzero(hi > lo)
            if depth < self.depth and len(rows) > 1 and len(wide):
                f = int(rng.choice(wide))
                t = float(rng.uniform(lo[f], hi[f]))
                go = rows[:, f] <= t
                left_hi, right_lo = hi.copy(), lo.copy()
                left_hi[f], right_lo[f] = t, t
                left = grow(rows[go], lo, left_hi, depth + 1)
                right = grow(rows[~go], right_lo, hi, depth + 1)
                nodes[me] = (f, t, left, right, 0.0)
            return me

        for k in range(self.trees):
            own = rng.choice(len(x), size, replace=False)
            self.unseen[k, own] = False
            self.roots.append(grow(x[own], low, high, 0))
        self.column, self.value, self.left, self.right, self.path = (np.array(v) for v in zip(*nodes, strict=True))
        self.norm = float(expected_path(size)) or 1.0
        return self

    def paths(self, x: np.ndarray, root: int) -> np.ndarray:
        at, rows = np.full(len(x), root), np.arange(len(x))
        for _ in range(self.depth):
            at = np.where(x[rows, self.column[at]] <= self.value[at], self.left[at], self.right[at])
        return self.path[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the nearer to 1, the shorter the paths."""
        total = np.zeros(len(x))
        for root in self.roots:
            total += self.paths(x, root)
        return 2.0 ** (-total / max(len(self.roots), 1) / self.norm)

    def score_unseen(self, x: np.ndarray) -> np.ndarray:
        """Scores of the very rows that the forest was fitted on, each by the trees that haven't seen it."""
        total = np.zeros(len(x))
        for root, apart in zip(self.roots, self.unseen, strict=True):
            total[apart] += self.paths(x[apart], root)
        return 2.0 ** (-total / np.maximum(self.unseen.sum(0), 1) / self.norm)
