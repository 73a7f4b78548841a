"""A small random forest: grown in numpy on the driver, applied as a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def grow(x, y, *, trees: int = 21, depth: int = 6, least: int = 3, seed: int = 5) -> list:
    """Trees as nested (feature, cut, left, right) tuples with probabilities as leaves.

    Each tree sees a bootstrap sample and, at each node, a random third of the
    features; splits maximise the gain in Gini impurity. Left is ``<= cut``.
    """
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    n, d = x.shape
    tries = max(2, -(-d // 3))

    def node(rows, level):
        p = float(y[rows].mean())
        if level == depth or len(rows) < 2 * least or p in (0.0, 1.0):
            return round(p, 6)
        best = (1e-9, None, None)
        for f in rng.choice(d, tries, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(order))
            ok = (v[1:] > v[:-1]) & (k >= least) & (len(order) - k >= least)
            if not ok.any():
                continue
            a, b = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(order) - k)
            gain = p * (1 - p) - (k * a * (1 - a) + (len(order) - k) * b * (1 - b)) / len(order)
            gain = np.where(ok, gain, -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
        if best[1] is None:
            return round(p, 6)
        left = x[rows, best[1]] <= best[2]
        return (best[1], round(best[2], 9), node(rows[left], level + 1), node(rows[~left], level + 1))

    return [node(rng.integers(0, n, n), 0) for _ in range(trees)]


def apply(tree, row) -> float:
    """One tree's probability for one row of features."""
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def expression(trees: list, feature: Callable[[int], Column]) -> Column:
    """Mean of the trees' probabilities as a column; ``feature`` gives the column of a feature."""

    def one(t) -> Column:
        return F.when(feature(t[0]) <= F.lit(t[1]), one(t[2])).otherwise(one(t[3])) if isinstance(t, tuple) else F.lit(float(t))

    total = one(trees[0])
    for t in trees[1:]:
        total = total + one(t)
    return total / F.lit(float(len(trees)))
