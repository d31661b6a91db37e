"""Isolation forest in numpy: all trees are filled level by level at once, and all rows fall through them at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def expected_path(n):
    """Mean depth of an unsuccessful search among n rows; 0 for n below 2."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649015329) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@lru_cache(maxsize=4)
def _cuts(trees: int, depth: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature and cut of every node of every tree, by level. A cut is drawn over the whole room of its node, which starts as the unit cube."""
    rng = np.random.default_rng(seed)
    low, high = np.zeros((trees, 1, dims)), np.ones((trees, 1, dims))
    out = []
    for level in range(depth):
        chosen = rng.integers(0, dims, (trees, 1 << level))
        at = chosen[:, :, None]
        lo, hi = np.take_along_axis(low, at, 2), np.take_along_axis(high, at, 2)
        cut = lo + (hi - lo) * rng.random((trees, 1 << level, 1))
        left, right = high.copy(), low.copy()
        np.put_along_axis(left, at, cut, 2)
        np.put_along_axis(right, at, cut, 2)
        low = np.stack([low, right], axis=2).reshape(trees, 2 << level, dims)
        high = np.stack([left, high], axis=2).reshape(trees, 2 << level, dims)
        out.append((chosen.ravel().astype(np.intp), cut.ravel()))
    return out


class IsolationForest:
    """trees trees, each filled with psi of the rows, without replacement; features lie between 0 and 1.

    Cuts are drawn over the whole room of a node, not only over the part that its rows take up: where they lie does not depend on the rows, but where a tree ends does. A node with at most one row of the sample is a leaf; depth ends others, which count for the depth that their rows would still need. So a row beyond all rows of the sample is isolated as early as one that was drawn, a clean source has no high scores, and a score means the same for every source.
    """

    def __init__(self, rows: np.ndarray, trees: int = 64, psi: int = 128, depth: int = 8, seed: int = 0):
        n, dims = rows.shape
        self.trees, self.depth, self.dims, self.norm = trees, depth, dims, float(expected_path(psi))
        pick = np.argpartition(np.random.default_rng(seed).random((trees, n), dtype=np.float32), min(psi, n) - 1, axis=1)[:, :psi] if n > psi else np.broadcast_to(np.arange(n), (trees, n))
        self.length = np.full((trees, 1), -1.0)
        for level, node in enumerate(self._fall(rows.T[:, pick])):
            if level:
                self.length = np.repeat(self.length, 2, axis=1)
            size = np.bincount((node + (np.arange(trees)[:, None] << level)).ravel(), minlength=trees << level).reshape(trees, -1)
            ends = size <= 1 if level < depth else True
            self.length = np.where((self.length < 0) & ends, level + expected_path(size) * (level == depth), self.length)
        self.length = self.length.astype(np.float32)

    def _fall(self, x: np.ndarray):
        """Node of each row in each tree, (trees, rows), level by level; x is (dims, rows), or (dims, trees, rows) with rows of its own for each tree."""
        m = x.shape[-1]
        flat = np.ascontiguousarray(x).ravel()
        t = np.arange(self.trees)[:, None]
        stride = m * (self.trees if x.ndim == 3 else 1)
        r = np.arange(m) + (t * m if x.ndim == 3 else 0)
        node = np.zeros((self.trees, m), dtype=np.intp)
        yield node
        for level, (feature, cut) in enumerate(_cuts(self.trees, self.depth, self.dims, 0)):
            at = node + (t << level)
            node = 2 * node + (flat.take(feature.take(at) * stride + r) >= cut.take(at))
            yield node

    def score(self, rows: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """2 ** (-mean depth / expected depth) of each row: near 1 for rows that are isolated early, under 0.5 for ordinary ones."""
        out = np.empty(len(rows))
        length, t = self.length.ravel(), np.arange(self.trees)[:, None]
        for i in range(0, len(rows), chunk):
            *_, node = self._fall(rows[i : i + chunk].T)
            out[i : i + chunk] = np.exp2(-length.take(node + (t << self.depth)).mean(axis=0, dtype=np.float64) / self.norm)
        return out
