"""Gradient boosting over counted feature patterns, compiled into one SQL expression.

All features are small categories, so a corpus of any size folds into one row per pattern with its number of
rows and of positives: training reads every row, and what reaches the driver is bounded by the product of the
feature sizes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from math import exp, inf, log

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Pattern:
    values: tuple[int, ...]
    rows: float
    positives: float
    score: float = 0.0


@dataclass(frozen=True)
class Node:
    """A test feature == value with a branch for either answer, or a leaf."""

    leaf: float = 0.0
    feature: int = -1
    value: int = 0
    yes: Node | None = None
    no: Node | None = None

    def at(self, values: tuple[int, ...]) -> float:
        node = self
        while node.feature >= 0:
            node = node.yes if values[node.feature] == node.value else node.no
        return node.leaf

    def sql(self, feature: Callable[[int], Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.leaf)
        return F.when(feature(self.feature) == self.value, self.yes.sql(feature)).otherwise(self.no.sql(feature))


@dataclass
class Model:
    base: float
    trees: list[Node] = field(default_factory=list)

    def at(self, values: tuple[int, ...]) -> float:
        return self.base + sum(t.at(values) for t in self.trees)

    def sql(self, feature: Callable[[int], Column]) -> Column:
        return reduce(lambda a, t: a + t.sql(feature), self.trees, F.lit(self.base))


def chance(score: float) -> float:
    return 1 / (1 + exp(-max(-30.0, min(30.0, score))))


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int, ridge: float, rate: float) -> Node:
    """rows: values, gradient, curvature. Newton steps; ties go to the first feature and the smallest value."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if depth and len(rows) > 1:
        best, gain = None, 1e-6
        for f in range(len(rows[0][0])):
            sums: dict[int, list[float]] = {}
            for values, a, b in rows:
                s = sums.setdefault(values[f], [0.0, 0.0])
                s[0] += a
                s[1] += b
            for v in sorted(sums) if len(sums) > 1 else ():
                a, b = sums[v]
                x = a * a / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g * g / (h + ridge)
                if x > gain + 1e-9:
                    best, gain = (f, v), x
        if best:
            f, v = best
            return Node(0.0, f, v, *(_grow([r for r in rows if (r[0][f] == v) is side], depth - 1, ridge, rate) for side in (True, False)))
    return Node(rate * g / (h + ridge))


def fit(patterns: list[Pattern], trees: int = 20, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Model:
    """Logistic boosting; deterministic for a given set of patterns. Without rows of both classes, a constant."""
    patterns = sorted(patterns, key=lambda p: p.values)
    n, k = sum(p.rows for p in patterns), sum(p.positives for p in patterns)
    p0 = (k + 0.5) / (n + 1)
    model = Model(log(p0 / (1 - p0)))
    if not 0 < k < n:
        return model
    for p in patterns:
        p.score = model.base
    for _ in range(trees):
        rows = [(p.values, p.positives - p.rows * (q := chance(p.score)), p.rows * q * (1 - q)) for p in patterns]
        tree = _grow(rows, depth, ridge, rate)
        model.trees.append(tree)
        for p in patterns:
            p.score += tree.at(p.values)
    return model


def threshold(model: Model, held_out: list[Pattern], precision: float, support: float) -> float:
    """Lowest score at which held-out rows of that score and more reach ``precision`` (one false row added) with ``support`` positives; inf if none does."""
    scored = sorted(((model.at(p.values), p.rows, p.positives) for p in held_out), reverse=True)
    best, n, k = inf, 0.0, 0.0
    for i, (s, rows, positives) in enumerate(scored):
        n, k = n + rows, k + positives
        if (i + 1 == len(scored) or scored[i + 1][0] < s) and k >= support and k / (n + 1) >= precision:
            best = s
    return best
