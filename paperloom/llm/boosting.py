"""Small gradient-boosted trees: trained with numpy on the driver, applied in numpy or in SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A complete tree in heap order: inner nodes test `x[feature] <= cut`, leaves hold values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray


@dataclass
class Model:
    start: float
    trees: list[Tree]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(tree.feature):
                node = 2 * node + 1 + (x[rows, tree.feature[node]] > tree.cut[node])
            total += tree.leaf[node - len(tree.feature)]
        return total

    def sql(self, names: list[str]) -> str:
        """The same log-odds as a SQL expression over columns `names`."""
        def walk(tree: Tree, node: int) -> str:
            if node >= len(tree.feature):
                return f"{float(tree.leaf[node - len(tree.feature)])!r}D"
            name, cut = names[tree.feature[node]], float(tree.cut[node])
            if not np.isfinite(cut):
                return walk(tree, 2 * node + 1)
            return f"if({name} <= {cut!r}D, {walk(tree, 2 * node + 1)}, {walk(tree, 2 * node + 2)})"
        return " + ".join([f"{self.start!r}D", *(walk(t, 0) for t in self.trees)])


def _best_split(x, g, h, rows, cuts, smooth):
    """Feature and cut of the largest gain over the rows of one node."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-9, 0, np.inf)
    base = total_g ** 2 / (total_h + smooth)
    for feature, edges in enumerate(cuts):
        if not len(edges):
            continue
        bins = np.searchsorted(edges, x[rows, feature], "left")
        left_g = np.cumsum(np.bincount(bins, g[rows], len(edges) + 1))[:-1]
        left_h = np.cumsum(np.bincount(bins, h[rows], len(edges) + 1))[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g ** 2 / (left_h + smooth) + right_g ** 2 / (right_h + smooth) - base
        gain[(left_h < 1e-3) | (right_h < 1e-3)] = 0
        top = int(gain.argmax())
        if gain[top] > best[0]:
            best = (gain[top], feature, edges[top])
    return best[1], best[2]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 3,
        rate: float = 0.3, smooth: float = 1.0, bins: int = 32) -> Model:
    """Logistic boosting with second-order leaf values."""
    weight = np.ones(len(y)) if weight is None else weight.astype(float)
    if not len(y):
        return Model(0.0, [])
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(share / (1 - share))), [])
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(column) else np.array([]) for column in x.T]
    cuts = [c[c < column.max()] for c, column in zip(cuts, x.T, strict=True)]
    score = np.full(len(y), model.start)
    inner = 2 ** depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        members = {0: np.arange(len(y))}
        for node in range(inner):
            rows = members.pop(node)
            if len(rows):
                feature[node], cut[node] = _best_split(x, g, h, rows, cuts, smooth)
            right = x[rows, feature[node]] > cut[node]
            members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
        leaf = np.array([rate * g[members[n]].sum() / (h[members[n]].sum() + smooth) for n in range(inner, 2 * inner + 1)])
        for n in range(inner, 2 * inner + 1):
            score[members[n]] += leaf[n - inner]
        model.trees.append(Tree(feature, cut, leaf))
    return model


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest log-odds from which on the given precision holds on these rows; infinite if none does."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True) if len(y) else np.array([], bool)
    good = np.flatnonzero((right >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else float("inf")
