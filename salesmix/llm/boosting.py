"""Gradient-boosted trees on binned features, for models fitted on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Logistic model: the sum of complete binary trees of one depth."""

    depth: int
    start: float
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def decide(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - (2 ** self.depth - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.decide(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 4,
              rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; deterministic."""
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col) for e, col in zip(edges, x.T, strict=True)], axis=1)
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Trees(depth, float(np.log(mean / (1 - mean))))
    decision = np.full(len(y), model.start)
    inner = 2 ** depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-decision))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            local = node - first
            best = np.full(count, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * bins + binned[:, f]
                g = np.bincount(key, grad, count * bins).reshape(count, bins).cumsum(axis=1)
                h = np.bincount(key, hess, count * bins).reshape(count, bins).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = (g ** 2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge)
                        - gt ** 2 / (ht + ridge))[:, :len(e)]
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                feature[first:first + count][better] = f
                cut[first:first + count][better] = e[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        slot = node - inner
        leaf = -rate * np.bincount(slot, grad, inner + 1) / (np.bincount(slot, hess, inner + 1) + ridge)
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(leaf)
        decision = decision + leaf[slot]
    return model
