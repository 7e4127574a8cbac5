"""Gradient-boosted trees for two classes, in numpy: histograms, full trees of one depth, logistic loss."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    base: float
    feature: np.ndarray  # tree, inner node in level order
    cut: np.ndarray  # go right above it
    value: np.ndarray  # tree, leaf


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0, weight: np.ndarray | None = None) -> Trees:
    """Fits rows x to labels y in (0, 1). A node that no cut improves sends all its rows left."""
    n, f = x.shape
    w = np.ones(n) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    mean = float((w * y).sum() / w.sum())
    base = float(np.log(mean / (1 - mean))) if 0 < mean < 1 else (20.0 if mean else -20.0)
    score = np.full(n, base)
    feature, cut, value = [], [], []
    wide = bins + 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = w * (y - p), w * p * (1 - p)
        node = np.zeros(n, np.int64)
        fs, cs = [], []
        for level in range(depth):
            count = 1 << level
            best = np.zeros(count)
            at_f, at_b = np.zeros(count, np.int64), np.full(count, wide)
            for j in range(f):
                if not len(cuts[j]):
                    continue
                key = node * wide + binned[:, j]
                g = np.bincount(key, grad, count * wide).reshape(count, wide).cumsum(1)
                h = np.bincount(key, hess, count * wide).reshape(count, wide).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g * g / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt * gt / (ht + ridge)
                gain = gain[:, : len(cuts[j])]
                b = gain.argmax(1)
                top = gain[np.arange(count), b]
                better = top > best + 1e-9
                best[better], at_f[better], at_b[better] = top[better], j, b[better]
            node = node * 2 + (binned[np.arange(n), at_f[node]] > at_b[node])
            fs += at_f.tolist()
            cs += [float(cuts[j][b]) if b < wide else np.inf for j, b in zip(at_f, at_b)]
        leaves = 1 << depth
        v = rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + ridge)
        score = score + v[node]
        feature.append(fs)
        cut.append(cs)
        value.append(v)
    return Trees(base, np.array(feature), np.array(cut), np.array(value))


def logits(model: Trees, x: np.ndarray) -> np.ndarray:
    """The log odds of each row."""
    out = np.full(len(x), model.base)
    rows = np.arange(len(x))
    inner = model.feature.shape[1]
    for feature, cut, value in zip(model.feature, model.cut, model.value):
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < inner:
            node = node * 2 + 1 + (x[rows, feature[node]] > cut[node])
        out += value[node - inner]
    return out
