"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most BINS quantile bins; trees grow level by level to a
fixed depth on the binned histogram of gradients, and are kept as flat arrays (a
complete binary tree a row), which score() walks for all rows at once.

Without rows, or with rows of one class only, there are no trees: every score is the share
of the class, 0.5 without rows. Features are finite numbers; rows and features may repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    base: float
    feature: np.ndarray  # [trees, 2 ** depth - 1]
    cut: np.ndarray  # go right if the value is greater
    leaf: np.ndarray  # [trees, 2 ** depth]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, inner, rows = np.full(len(x), self.base), self.feature.shape[1], np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, l2: float = 1.0, least: float = 1.0) -> Forest:
    """x [rows, features], y 0 or 1. With no rows or one class, a constant: the class's smoothed rate."""
    n, width = x.shape
    p = (y.sum() + 0.5) / (n + 1.0)
    base, inner = float(np.log(p / (1 - p))), 2**depth - 1
    if n == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * BINS
    cuts = np.full((width, BINS), np.inf)
    for f, e in enumerate(edges):
        cuts[f, : len(e)] = e
    margin, made = np.full(n, base), []
    for _ in range(trees):
        prob = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            shape = (count, width, BINS)
            g = np.bincount(key, np.repeat(grad, width), count * width * BINS).reshape(shape)
            h = np.bincount(key, np.repeat(hess, width), count * width * BINS).reshape(shape)
            gl, hl = g.cumsum(2), h.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            gain[(hl < least) | (ha - hl < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            feature[first : first + count] = np.where(good, best // BINS, 0)
            cut[first : first + count] = np.where(good, cuts[best // BINS, best % BINS], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        value = -rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + l2)
        margin += value[at]
        made.append((feature, cut, value))
    return Forest(base, *(np.stack(part) for part in zip(*made)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from score to rate."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # rate, weight, first and last score
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([t, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b = blocks.pop()
            a = blocks[-1]
            w = a[1] + b[1]
            blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]]
    # Rates are drawn a little to their middle, so that no score is certain.
    xs = [x for b in blocks for x in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    ys = [(b[0] * b[1] + 0.1) / (b[1] + 0.2) for b in blocks for _ in range(2 if b[3] > b[2] else 1)]
    return np.array(xs), np.maximum.accumulate(np.array(ys))
