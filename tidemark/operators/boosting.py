"""Gradient-boosted trees over counted cells: what Spark ML's GBTClassifier learns, without a job for each level of each tree.

Trees only see which of at most 32 bins a feature's value is in, so rows with equal bins and label are alike: one pass
counts them, and boosting goes on over the counts, at most 2 * 32 ** 4 of them for four features however many rows there
are. Loss, weights, least rows of a leaf and order among equal gains are GBTClassifier's. Bin edges come from a sketch of
all rows (ranks to 1 in 10,000) instead of 10,000 sampled rows.

Defined results: rows without a label aren't learned from; a missing value is in the lowest bin, NaN in the highest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, GRID, ACCURACY = 32, 4000, 10_000
#: A node whose residuals vary less isn't split.
EPSILON = 2.0**-52


@dataclass
class Model:
    """Edges of the bins, and trees as arrays by node (children of i at 2 i + 1 and 2 i + 2): feature (-1: leaf), last bin of the left child, value."""

    names: list[str]
    edges: list[np.ndarray]
    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray
    depth: int

    def probability(self) -> Column:
        """Probability of label 1; each task computes that of a cell once."""
        feature, last, value, depth, sizes = self.feature, self.last, self.value, self.depth, [len(e) + 1 for e in self.edges]

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = np.full(math.prod(sizes), np.nan)
            for batch in batches:
                code = batch.to_numpy(np.int64)
                new = np.unique(code[np.isnan(known[code])])
                bins = np.stack(np.unravel_index(new, sizes), 1) if len(new) else np.empty((0, len(sizes)), np.int64)
                margin, rows = np.zeros(len(new)), np.arange(len(new))
                for f, t, v in zip(feature, last, value, strict=True):
                    at = np.zeros(len(new), np.int64)
                    for _ in range(depth):
                        at = np.where(f[at] < 0, at, 2 * at + 1 + (bins[rows, f[at]] > t[at]))
                    margin += v[at]
                known[new] = 1 / (1 + np.exp(-2 * margin))
                yield pd.Series(known[code])

        return F.pandas_udf(run, "double")(code(self.names, self.edges))


def edges_of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Ascending edges between bins of about equal weight: midway between neighbours, all of them if there are fewer than BINS."""
    values, at = np.unique(values, return_inverse=True)
    weights = np.bincount(at, weights, len(values))
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < BINS:
        return middle
    out, sums = [], weights.cumsum()
    step = target = sums[-1] / BINS
    for k in range(len(middle)):
        if abs(sums[k] - target) < abs(sums[k + 1] - target):
            out.append(middle[k])
            target += step
    return np.array(out[: BINS - 1])


def code(names: list[str], edges: list[np.ndarray]) -> Column:
    """Number of a row's cell."""

    def bin_of(name: str, own: list[float], first: int) -> str:
        if not own:
            return str(first)
        k = len(own) // 2
        return f"IF(`{name}` > {own[k]!r}D, {bin_of(name, own[k + 1 :], first + k + 1)}, {bin_of(name, own[:k], first)})"

    out = "0L"
    for name, own in zip(names, edges, strict=True):
        out = f"({out} * {len(own) + 1} + {bin_of(name, own.tolist(), 0)})"
    return F.expr(out)


def grow(bins: np.ndarray, sizes: list[int], y: np.ndarray, weight: np.ndarray, count: np.ndarray, depth: int, least: int, share: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One regression tree over cells: feature, last and value by node, and the node of each cell."""
    total = 2 ** (depth + 1) - 1
    feature, last, value = np.full(total, -1), np.zeros(total, np.int64), np.zeros(total)
    at, n_features = np.zeros(len(y), np.int64), len(sizes)
    parts = np.stack([weight, weight * y, weight * y * y, count])

    def impurity(s: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(s[0] > 0, (s[2] - s[1] * s[1] / s[0]) / s[0], 0.0)

    for level in range(depth + 1):
        first, n = 2**level - 1, 2**level
        here = np.flatnonzero(at >= first)
        if not len(here):
            break
        node = at[here] - first
        whole = np.stack([np.bincount(node, p[here], n) for p in parts])
        value[first : first + n] = np.divide(whole[1], whole[0], out=np.zeros(n), where=whole[0] > 0)
        if level == depth:
            break
        own = impurity(whole)
        gains = np.full((n, n_features, BINS - 1), -np.inf)
        for f, size in enumerate(sizes):
            if size > 1:
                cells = np.stack([np.bincount(node * size + bins[here, f], p[here], n * size).reshape(n, size) for p in parts])
                left = cells.cumsum(2)[:, :, :-1]
                right = whole[:, :, None] - left
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = own[:, None] - left[0] / whole[0][:, None] * impurity(left) - right[0] / whole[0][:, None] * impurity(right)
                gains[:, f, : size - 1] = np.where((left[3] >= least) & (right[3] >= least), gain, -np.inf)
        if share < 1:
            drawn = rng.random((n, n_features)).argsort(1) < math.ceil(share * n_features)
            gains[~drawn] = -np.inf
        best = gains.reshape(n, -1).argmax(1)
        ok = (gains.reshape(n, -1)[np.arange(n), best] > 0) & (own >= EPSILON)
        f, t = np.unravel_index(best, gains.shape[1:])
        feature[first : first + n], last[first : first + n] = np.where(ok, f, -1), t
        go = here[ok[node]]
        node = node[ok[node]]
        at[go] = 2 * at[go] + 1 + (bins[go, f[node]] > t[node])
    return feature, last, value, at


def fit(
    train: DataFrame, names: list[str], *, rounds: int, rate: float, depth: int, least: int, weight: float | None = None, row_share: float = 1.0, feature_share: float = 1.0, seed: int = 0
) -> Model | None:
    """Boosted trees that tell label 1.0, of the given weight (by default rows of 0.0 per row of 1.0), from 0.0; None if there is one class only."""
    grid = ",".join(repr((k + 0.5) / GRID) for k in range(GRID))  # as one text: thousands of literals take the planner seconds
    sketches = [F.expr(f"percentile_approx(CAST(`{x}` AS DOUBLE), CAST(split('{grid}', ',') AS ARRAY<DOUBLE>), {ACCURACY})").alias(x) for x in names]
    classes = train.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"), *sketches).collect()  # two classes
    if len(classes) < 2:
        return None
    n = {r.label: r.n for r in classes}
    weight = weight or n[0.0] / n[1.0]
    edges = []
    for x in names:
        values, each = [np.empty(0)], [np.empty(0)]
        for r in classes:
            v, hits = np.unique(np.array(r[x] or [], float), return_counts=True)
            values.append(v[np.isfinite(v)])
            each.append(np.rint(hits * r.n / GRID)[np.isfinite(v)] * (weight if r.label == 1 else 1.0))  # exact up to GRID / 2 rows
        edges.append(edges_of(np.concatenate(values), np.concatenate(each)))
    sizes = [len(e) + 1 for e in edges]
    cells = train.where("label IS NOT NULL").select(code(names, edges).alias("code"), "label").groupBy("code", "label").count().toArrow().sort_by([("code", "ascending"), ("label", "ascending")])
    bins = np.stack(np.unravel_index(cells.column("code").to_numpy(), sizes), 1)
    y, rows = 2 * cells.column("label").to_numpy() - 1, cells.column("count").to_numpy().astype(np.int64)
    each, margin, rng = np.where(y > 0, weight, 1.0), np.zeros(len(y)), np.random.default_rng(seed)
    trees, residual = [], y
    for k in range(rounds):
        count = rng.binomial(rows, row_share) if row_share < 1 else rows
        feature, last, value, at = grow(bins, sizes, residual, each * count, count.astype(float), depth, least, feature_share, rng)
        value = value * (rate if k else 1.0)
        trees.append((feature, last, value))
        margin += value[at]
        residual = 4 * y / (1 + np.exp(2 * y * margin))
    return Model(names, edges, *map(np.stack, zip(*trees, strict=True)), depth)
