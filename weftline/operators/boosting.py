"""Gradient boosting of small trees on binned features, with squared or quantile loss. Plain numpy, for one series at a time."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Leaf-wise trees: rounds of them, each of at most leaves leaves and least rows in a leaf."""

    def __init__(self, rounds: int = 100, rate: float = 0.1, leaves: int = 31, depth: int | None = None, l2: float = 0.0, least: int = 20, bins: int = 64, quantile: float | None = None):
        self.rounds, self.rate, self.leaves, self.depth, self.l2, self.least, self.bins, self.quantile = rounds, rate, leaves, depth, l2, least, bins, quantile

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self._edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        codes = self._codes(x)
        self._start = float(y.mean() if self.quantile is None else np.quantile(y, self.quantile))
        now, self._trees = np.full(len(y), self._start), []
        for _ in range(self.rounds):
            rest = y - now
            pull = rest if self.quantile is None else np.where(rest > 0, self.quantile, self.quantile - 1)
            tree, leaf = self._grow(codes, pull, rest)
            self._trees.append(tree)
            now = now + leaf
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self._edges)], axis=1)

    def _best(self, codes: np.ndarray, pull: np.ndarray, rows: np.ndarray) -> tuple[float, int, int] | None:
        """(gain, feature, cut) of the best split of the rows; codes up to the cut go left."""
        n, total = len(rows), pull[rows].sum()
        if n < 2 * self.least:
            return None
        width, k = self.bins, codes.shape[1]
        flat = (codes[rows] + np.arange(k) * width).ravel()
        count = np.bincount(flat, minlength=k * width).reshape(k, width).cumsum(axis=1)
        weight = np.bincount(flat, np.repeat(pull[rows], k), minlength=k * width).reshape(k, width).cumsum(axis=1)
        good = (count >= self.least) & (n - count >= self.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = weight**2 / (count + self.l2) + (total - weight) ** 2 / (n - count + self.l2) - total**2 / (n + self.l2)
        gain = np.where(good, gain, -np.inf)
        at = int(gain.argmax())
        best = float(gain.flat[at])
        return (best, at // width, at % width) if best > 1e-12 else None

    def _grow(self, codes: np.ndarray, pull: np.ndarray, rest: np.ndarray) -> tuple[list, np.ndarray]:
        out = np.zeros(len(pull))
        nodes: list = [None]
        open_ = [(0, np.arange(len(pull)), 0, self._best(codes, pull, np.arange(len(pull))))]
        leaves = 1
        done = []
        while open_:
            k = max(range(len(open_)), key=lambda i: open_[i][3][0] if open_[i][3] else -1.0)
            at, rows, depth, split = open_.pop(k)
            if split is None or leaves >= self.leaves or (self.depth is not None and depth >= self.depth):
                done.append((at, rows))
                continue
            _, feature, cut = split
            left = codes[rows, feature] <= cut
            nodes[at] = (feature, cut, len(nodes), len(nodes) + 1)
            nodes += [None, None]
            leaves += 1
            for child, own in ((nodes[at][2], rows[left]), (nodes[at][3], rows[~left])):
                open_.append((child, own, depth + 1, self._best(codes, pull, own)))
        for at, rows in done:
            value = pull[rows].sum() / (len(rows) + self.l2) if self.quantile is None else np.quantile(rest[rows], self.quantile)
            nodes[at] = self.rate * float(value)
            out[rows] = nodes[at]
        return nodes, out

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes, out = self._codes(x), np.full(len(x), self._start)
        for tree in self._trees:
            for k in range(len(x)):
                node = tree[0]
                while isinstance(node, tuple):
                    node = tree[node[2] if codes[k, node[0]] <= node[1] else node[3]]
                out[k] += node
        return out
