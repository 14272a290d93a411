"""Gradient-boosted trees for two classes on a bounded table of numbers, found on histograms of the features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class BoostedTrees:
    """Complete trees in heap order: row ``t`` of each array holds tree ``t``; inner node ``i`` has children ``2i+1``, ``2i+2``."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (rows[every, feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return total


def fit(
    rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.2, smooth: float = 5.0, share: float = 0.5
) -> BoostedTrees:
    """Trees by logistic loss, each from a random ``share`` of the rows. The same rows in the same order give the same trees.

    Nodes that gain nothing from a split send all rows left. Without rows, or with one class only, the log-odds are
    those of the class, kept finite.
    """
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(width)], axis=1) if n else np.zeros((0, width), int)
    flat = binned + np.arange(width) * BINS
    positive, total = float((weights * labels).sum()), float(weights.sum())
    base = float(np.log((positive + 1) / (total - positive + 1)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    score = np.full(n, base)
    draw = np.random.default_rng(0)
    for t in range(trees):
        some = np.flatnonzero(draw.random(n) < share)
        p = 1 / (1 + np.exp(-score[some]))
        slope, curve = weights[some] * (labels[some] - p), weights[some] * p * (1 - p)
        each = (np.repeat(slope, width), np.repeat(curve, width))
        mine, bins, at = rows[some], flat[some], np.zeros(len(some), dtype=np.int64)
        for level in range(depth):
            first, here = (1 << level) - 1, 1 << level
            index = ((at - first)[:, None] * (width * BINS) + bins).ravel()
            shape = (here, width, BINS)
            g, h = (np.bincount(index, values, here * width * BINS).reshape(shape) for values in each)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
            # The last bin of a feature has nothing above it.
            best = gain.reshape(here, -1).argmax(axis=1)
            for i in range(here):
                f, b = divmod(int(best[i]), BINS)
                if gain[i, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[t, first + i], threshold[t, first + i] = f, cuts[f][b]
            at = 2 * at + 1 + (mine[np.arange(len(some)), feature[t, at]] > threshold[t, at])
        ends = at - inner
        g, h = np.bincount(ends, slope, leaves), np.bincount(ends, curve, leaves)
        leaf[t] = rate * g / (h + smooth)
        score += BoostedTrees(depth, 0.0, feature[t : t + 1], threshold[t : t + 1], leaf[t : t + 1]).log_odds(rows)
    return BoostedTrees(depth, base, feature, threshold, leaf)
