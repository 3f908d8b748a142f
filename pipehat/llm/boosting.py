"""Gradient-boosted trees with logistic loss and Platt calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """Complete trees of one depth: feature and cut of each inner node, value of each leaf, per tree."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    base: float
    scale: tuple[float, float] = (1.0, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.features.shape[1]
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * self.margin(x) + self.scale[1])


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, ridge: float):
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
    node = np.zeros(len(x), np.int64)
    for k in range(inner):
        own = node == k
        best = 1e-9
        if own.any():
            xs, gs, hs = x[own], g[own], h[own]
            whole = gs.sum() ** 2 / (hs.sum() + ridge)
            for f, candidates in enumerate(cuts):
                if len(candidates):
                    right = xs[:, f, None] > candidates
                    gr, hr = gs @ right, hs @ right
                    gain = gr**2 / (hr + ridge) + (gs.sum() - gr) ** 2 / (hs.sum() - hr + ridge) - whole
                    if gain.max() > best:
                        best = gain.max()
                        feature[k], cut[k] = f, candidates[gain.argmax()]
        node[own] = 2 * k + 1 + (x[own, feature[k]] > cut[k])
    for k in range(inner + 1):
        own = node == inner + k
        leaf[k] = -g[own].sum() / (h[own].sum() + ridge)
    return feature, cut, leaf


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, ridge: float = 1.0, bins: int = 12) -> Boosted:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[:-1])) for c in x.T]
    cuts = [np.setdiff1d(c, [col.max()]) for c, col in zip(cuts, x.T, strict=True)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(np.empty((0, 2**depth - 1), np.int64), np.empty((0, 2**depth - 1)), np.empty((0, 2**depth)), float(np.log(share / (1 - share))))
    margin, grown = np.full(len(x), model.base), []
    for _ in range(trees):
        p = sigmoid(margin)
        f, c, v = _tree(x, p - y, p * (1 - p), cuts, depth, ridge)
        grown.append((f, c, v * rate))
        margin += Boosted(f[None], c[None], v[None] * rate, 0.0).margin(x)
    model.features, model.cuts, model.leaves = (np.stack(z) for z in zip(*grown, strict=True))
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> None:
    """Platt scaling of the margins on rows that the trees have not seen."""
    m = model.margin(x)
    features = np.stack([m, np.ones_like(m)], 1)
    w = np.array([1.0, 0.0])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(rounds):
        p = sigmoid(features @ w)
        hess = (features * (p * (1 - p))[:, None]).T @ features + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, features.T @ (p - target))
        w -= np.clip(step, -1, 1)
    model.scale = (float(w[0]), float(w[1]))


def threshold(probabilities: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which on the share of positives is at least ``precision``."""
    order = np.argsort(-probabilities, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    return float(probabilities[order][good[-1]]) if len(good) else 1.0
