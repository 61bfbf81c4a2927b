"""Gradient-boosted trees in numpy, small enough to score as one SQL expression."""

from __future__ import annotations

import numpy as np


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, reg: float, least: int):
    """A regression tree of nested tuples (feature, cut, left if < cut, right); a leaf is a number."""
    leaf = float(-grad.sum() / (hess.sum() + reg))
    if depth == 0 or x.shape[0] < 2 * least:
        return leaf
    best, found = 1e-6, None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[1:]:
            low = x[:, f] < cut
            n = int(low.sum())
            if n < least or x.shape[0] - n < least:
                continue
            g, h = grad[low].sum(), hess[low].sum()
            g2, h2 = grad.sum() - g, hess.sum() - h
            gain = g * g / (h + reg) + g2 * g2 / (h2 + reg) - grad.sum() ** 2 / (hess.sum() + reg)
            if gain > best:
                best, found = gain, (f, float(cut), low)
    if not found:
        return leaf
    f, cut, low = found
    return (f, cut, _tree(x[low], grad[low], hess[low], depth - 1, reg, least), _tree(x[~low], grad[~low], hess[~low], depth - 1, reg, least))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(x.shape[0], tree)
    f, cut, left, right = tree
    return np.where(x[:, f] < cut, _apply(left, x), _apply(right, x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, reg: float = 1.0, least: int = 5) -> list:
    """Trees whose rate-scaled sum is the log-odds of y = 1; features are small integers."""
    score, out = np.zeros(y.size), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        out.append(_tree(x, p - y, p * (1 - p), depth, reg, least))
        score += rate * _apply(out[-1], x)
    return out


def score(model: list, x: np.ndarray, rate: float = 0.3) -> np.ndarray:
    return sum(rate * _apply(t, x) for t in model)


def threshold(scores: np.ndarray, y: np.ndarray, precision: float = 0.995) -> float:
    """The lowest score from which on the held-out precision is at least `precision`; equal scores
    are in or out together."""
    order = np.argsort(-scores)
    right = np.cumsum(y[order]) / np.arange(1, y.size + 1)
    last = np.r_[scores[order][1:] != scores[order][:-1], True]
    good = np.flatnonzero(last & (right >= precision))
    return float(scores[order][good[-1]]) if good.size else float("inf")


def sql(model: list, features: list[str], rate: float = 0.3) -> str:
    """The score as a SQL expression over expressions of the features."""

    def one(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{rate * tree:.12g}D"
        f, cut, left, right = tree
        return f"if({features[f]} < {cut:g}, {one(left)}, {one(right)})"

    return " + ".join(one(t) for t in model)
