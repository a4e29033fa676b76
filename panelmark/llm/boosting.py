"""Gradient-boosted trees for yes/no labels on a bounded table of features, in numpy.

Trees are complete and stored flat: node k of a tree has children 2k+1 and 2k+2, a
feature and a threshold; the leaves of the last level have a value. Scoring many rows
is one gather a level, and a tree turns into nested CASE expressions as it stands.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    depth: int
    bias: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; a row with a larger value goes right
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``."""
        rows, total = np.arange(len(x)), np.full(len(x), self.bias)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return total

    def expression(self, feature: Callable[[int], Column]) -> Column:
        """The same sum as a SQL expression over the columns ``feature(i)``."""

        def branch(t: int, node: int) -> Column:
            if node >= self.feature.shape[1]:
                return F.lit(float(self.value[t, node - self.feature.shape[1]]))
            threshold = float(self.threshold[t, node])
            if threshold == np.inf:
                return branch(t, 2 * node + 1)
            return F.when(feature(int(self.feature[t, node])) > threshold, branch(t, 2 * node + 2)).otherwise(branch(t, 2 * node + 1))

        total = F.lit(float(self.bias))
        for t in range(len(self.feature)):
            total = total + branch(t, 0)
        return total


def _best(hist: np.ndarray, low: float, high: float, l2: float, least: float, monotone: np.ndarray):
    """(gain, feature, bin, left value, right value) of the best split; hist: feature x bin x (gradient, curvature, rows)."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist.sum(axis=1, keepdims=True)
    right = whole - left
    weight = lambda s: np.clip(-s[..., 0] / (s[..., 1] + l2), low, high)
    w_left, w_right, w_all = weight(left), weight(right), weight(whole)
    score = lambda s, w: -(s[..., 0] * w + 0.5 * (s[..., 1] + l2) * w * w)
    gain = score(left, w_left) + score(right, w_right) - score(whole, w_all)
    allowed = (left[..., 2] >= least) & (right[..., 2] >= least) & (monotone[:, None] * (w_right - w_left) >= 0)
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return gain[f, b], f, b, w_left[f, b], w_right[f, b]


def fit(x: np.ndarray, y: np.ndarray, monotone=None, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """Trees for P(y = 1 | x). ``monotone[i]`` of 1 (-1) lets the odds only rise (fall) with feature i.

    A split that would break a constraint is not taken, and each side's later values
    are held on its side of the middle, so the whole sum is monotonic.
    """
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    n, width = x.shape
    monotone = np.zeros(width, int) if monotone is None else np.asarray(monotone)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * bins
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    inner, margin = 2**depth - 1, np.full(n, bias)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        sums = np.stack([p - y, p * (1 - p), np.ones(n)])
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        weight, bound = np.zeros(2 * inner + 1), {0: (-np.inf, np.inf)}
        node = np.zeros(n, np.int64)
        weight[0] = -sums[0].sum() / (sums[1].sum() + l2)
        for k in range(inner):
            low, high = bound[k]
            weight[2 * k + 1] = weight[2 * k + 2] = weight[k]
            bound[2 * k + 1] = bound[2 * k + 2] = (low, high)
            here = node == k
            if here.sum() >= 2 * least:
                hist = np.stack([np.bincount(flat[here].ravel(), np.repeat(s[here], width), width * bins).reshape(width, bins) for s in sums], axis=2)
                gain, f, b, w_left, w_right = _best(hist, low, high, l2, least, monotone)
                if gain > 1e-6:
                    feature[k], threshold[k] = f, edges[f][b]
                    weight[2 * k + 1], weight[2 * k + 2] = w_left, w_right
                    if monotone[f]:
                        middle = (w_left + w_right) / 2
                        falling = monotone[f] < 0
                        bound[2 * k + 1] = (middle, high) if falling else (low, middle)
                        bound[2 * k + 2] = (low, middle) if falling else (middle, high)
            node[here] = 2 * k + 1 + (x[here, feature[k]] > threshold[k])
        margin += rate * weight[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(rate * weight[inner:])
    return Trees(depth, bias, np.array(features), np.array(thresholds), np.array(values))


def folds(keys: np.ndarray, parts: int) -> np.ndarray:
    """A number below ``parts`` for each row, the same ones each time."""
    mixed = keys.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def split_fold(keys: np.ndarray, parts: int = 4) -> np.ndarray:
    """True for about one row in ``parts``, the same rows each time: the held-out part."""
    return folds(keys, parts) == 0
