"""Small decision trees and boosted trees in numpy, for models trained on a bounded labelled table on the driver."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Tree(NamedTuple):
    """Nodes in arrays; leaves have feature -1. A row goes left where its value is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(len(self.feature)):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            less = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(less, self.left[at], self.right[at]), at)
        return self.value[at]


def fit_tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float = 1.0, ridge: float = 1.0) -> Tree:
    """Newton tree: each leaf's value is minus its gradient by its hessian; splits are exact over the values' midpoints."""
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, -g / (h + ridge)])
        if level == depth or h < 2 * least:
            return me
        best = (1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            v = v[order]
            gs, hs = np.cumsum(gradient[rows][order])[:-1], np.cumsum(hessian[rows][order])[:-1]
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            gain[(v[1:] == v[:-1]) | (hs < least) | (h - hs < least)] = 0
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), f, float(v[k] + v[k + 1]) / 2)
        if best[1] < 0:
            return me
        less = x[rows, best[1]] <= best[2]
        nodes[me][0], nodes[me][1] = best[1], best[2]
        nodes[me][2] = grow(rows[less], level + 1)
        nodes[me][3] = grow(rows[~less], level + 1)
        return me

    grow(np.arange(len(x)), 0)
    a = np.array(nodes)
    return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4])


class Boosted(NamedTuple):
    """Boosted trees for a yes or no; ``scale`` and ``shift`` calibrate the margin on held-out rows."""

    trees: tuple[Tree, ...]
    rate: float
    base: float
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * tree(x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -30, 30)))


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3) -> Boosted:
    """Log-loss boosting on every other row, then Platt calibration on the rest."""
    train, held = slice(0, None, 2), slice(1, None, 2)
    xt, yt = x[train], y[train].astype(float)
    prior = min(max(yt.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    margin, trees = np.full(len(xt), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = fit_tree(xt, p - yt, p * (1 - p), depth)
        trees.append(tree)
        margin += rate * tree(xt)
    model = Boosted(tuple(trees), rate, base)
    m, yh, a, b = model.margin(x[held]), y[held].astype(float), 1.0, 0.0
    for _ in range(25):  # Newton steps of a ridged logistic regression on the margin
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = p * (1 - p)
        grad = np.array([(m * (p - yh)).sum() + 0.1 * (a - 1), (p - yh).sum() + 0.1 * b])
        hess = np.array([[(m * m * w).sum() + 0.1, (m * w).sum()], [(m * w).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return model._replace(scale=float(a), shift=float(b))


def threshold_for(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at which at least ``precision`` of what is selected is right; above 1 if there is none."""
    order = np.argsort(-probability, kind="stable")
    p, hits = probability[order], np.cumsum(y[order])
    good = hits / np.arange(1, len(p) + 1) >= precision
    good &= np.append(p[1:] < p[:-1], True)  # ties are selected together
    return float(p[np.flatnonzero(good)[-1]]) if good.any() else 2.0
