"""Toxicity by a classifier chain of linear models.

The categories are label columns and form a chain: each model sees the text's features and the probabilities that the
models before it give. While training, those probabilities are out-of-fold predictions, so a later model learns from predictions
of the quality that it meets later. Models are fitted on a bounded, documented sample of labelled rows; every
document is scored over its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicrill.llm.common import cut

#: Labelled rows at most, the first by hash of their id.
SAMPLE_ROWS = 6_000
#: Features at most, in even shares the best of each category by chi-square, among those of MIN_ROWS rows or more.
FEATURES, MIN_ROWS = 512, 5
FOLDS, NEWTON, RIDGE = 5, 10, 1e-3
#: Label columns of 0 and 1 along the chain, where the table has them; 1 is turned to 0 for those of good texts. The last one decides.
CHAIN, GOOD = ("quality", "toxic"), ("quality",)
PREFIXES, COUNTS = (5, 7), (1, 2, 4)

#: Steps of the measures of a text's shape; a feature says that a measure reaches a step.
SHARES, LENGTHS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), tuple(2**k for k in range(3, 14))

_WORDS = re.compile(r"[^\W_]+").findall
_SYMBOLS, _CAPITALS = re.compile(r"[#$%&*|<>!]").findall, re.compile(r"[A-Z]").findall


def shape(text: str) -> list[str]:
    """Steps that length and repetition reach: words, distinct words, repeated word triples, repeated lines, symbols, capitals."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    n, again = max(1, len(words)), lambda some: 1 - len(set(some)) / len(some) if some else 0.0
    shares = {
        "distinct": len(set(words)) / n,
        "triples": again(triples),
        "lines": again(lines),
        "symbols": len(_SYMBOLS(text)) / n,
        "capitals": len(_CAPITALS(text)) / max(1, len(text)),
    }
    return [f"#words{k}" for k in LENGTHS if n >= k] + [f"#{name}{k}" for name, x in shares.items() for k in SHARES if x >= k]


def features(text: str | None) -> set[str]:
    """Whole words, word beginnings with the number of different words that share them, and the text's shape."""
    words = set(_WORDS((text or "").lower()))
    starts = Counter(w[:n] for w in words for n in PREFIXES if len(w) > n)
    return {f"={w}" for w in words} | {f"{p}*{c}" for p, n in starts.items() for c in COUNTS if n >= c} | set(shape(text or ""))


@dataclass
class Chain:
    """Weights by category: features, then the earlier categories' probabilities, then a constant."""

    names: tuple[str, ...]
    features: list[str]
    weights: list[np.ndarray]
    limit: float

    def __post_init__(self) -> None:
        self.at = {f: i for i, f in enumerate(self.features)}
        self.words = {f[1:]: i for f, i in self.at.items() if f[0] == "="}
        self.shapes = {f: i for f, i in self.at.items() if f[0] == "#"}
        self.starts: dict[str, list[tuple[int, int]]] = {}
        for f, i in self.at.items():
            if f[0] not in "=#":
                p, c = f.rsplit("*", 1)
                self.starts.setdefault(p, []).append((int(c), i))

    def known(self, text: str | None) -> list[int]:
        """Numbers of the model's features that a text has; the same as features(), without building the others."""
        words = set(_WORDS((text or "").lower()))
        out = [self.words[w] for w in words & self.words.keys()]
        if self.starts:
            for p, n in Counter([p for w in words for k in PREFIXES if len(w) > k and (p := w[:k]) in self.starts]).items():
                out += [i for c, i in self.starts[p] if n >= c]
        if self.shapes:
            out += [self.shapes[f] for f in shape(text or "") if f in self.shapes]
        return out

    def chances(self, texts: list[str | None]) -> np.ndarray:
        """A row of probabilities for each text, in the order of the chain."""
        known = [self.known(t) for t in texts]
        n = len(self.features)
        p = np.zeros((len(texts), len(self.names)))
        for k, w in enumerate(self.weights):
            own = np.array([w[:n][i].sum() for i in known])
            p[:, k] = chance(own + p[:, :k] @ w[n : n + k] + w[-1])
        return p


def chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved while they do not help; the last column of x is the constant."""
    n = max(1, len(x))
    w = np.zeros(x.shape[1])
    p = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(p / (1 - p))
    if not 0 < y.sum() < n:
        return w
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        odds = (x @ w.astype(np.float32)).astype(np.float64)
        return float((np.logaddexp(0, odds) - y * odds).mean() + (ridge * w * w).sum() / 2), odds

    now, odds = loss(w)
    for _ in range(NEWTON):
        q = chance(odds)
        slope = x.T @ ((q - y) / n).astype(np.float32) + ridge * w
        bend = (x * (q * (1 - q) / n).astype(np.float32)[:, None]).T @ x
        step = np.linalg.solve(bend.astype(np.float64) + np.diag(ridge), slope)
        size = 1.0
        while size > 1e-3 and (after := loss(w - size * step))[0] > now:
            size /= 2
        if size <= 1e-3 or now - after[0] < 1e-7:
            break
        w, (now, odds) = w - size * step, after
    return w


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on out-of-fold predictions have the best F1; 1.1 (nothing) without positives."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not len(y) or not hits[-1]:
        return 1.1
    f = 2 * hits / (np.arange(len(y)) + 1 + hits[-1])
    last = np.r_[p[order][1:] < p[order][:-1], True]
    k = int(np.argmax(np.where(last, f, -1)))
    below = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + below) / 2)


def fit(rows: list[tuple[int, list[int], list[int | None]]], names: tuple[str, ...], chosen: list[str]) -> Chain:
    """rows: fold, numbers of the chosen features, labels along the chain. A row without a label of a category does not fit its models, but gets their predictions."""
    n, m = len(rows), len(chosen)
    x = np.zeros((n, m), np.float32)
    for i, (_, has, _) in enumerate(rows):
        x[i, has] = 1
    fold = np.array([r[0] for r in rows], np.int64)
    earlier, weights = np.zeros((n, 0)), []
    for k in range(len(names)):
        y = np.array([np.nan if r[2][k] is None else r[2][k] for r in rows], np.float64)
        known = ~np.isnan(y)
        z = np.hstack([x, earlier, np.ones((n, 1))]).astype(np.float32)
        weights.append(logistic(z[known], y[known]))
        held = np.zeros(n)
        for f in range(FOLDS):
            out = fold == f
            if out.any():
                held[out] = chance(z[out] @ logistic(z[known & ~out], y[known & ~out]))
        earlier = np.hstack([earlier, held[:, None]])
    return Chain(names, chosen, weights, best_limit(held, np.array([r[2][-1] for r in rows], np.float64)))


def choose(sample: DataFrame, labels: list[str]) -> list[str]:
    """The features of ``sample`` (features, 0/1 labels) that tell the classes of any label apart, an even share of FEATURES for each.

    Rows without a label do not count for it. A label of one class alone chooses none. Ties go by the feature's text.
    """
    both = lambda y: (F.count(y).alias(f"n{y}"), F.sum(y).alias(f"k{y}"))
    totals = sample.agg(*[x for y in labels for x in both(y)]).first()
    counts = sample.select(*labels, F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), *[x for y in labels for x in both(y)])
    counts = cut(counts.filter(F.col("rows") >= MIN_ROWS), "toxicity-features")
    chosen: dict[str, None] = {}
    for y in labels:
        n, k = totals[f"n{y}"], totals[f"k{y}"] or 0
        if not 0 < k < n:
            continue
        c, p = F.col(f"n{y}"), F.col(f"k{y}")
        expected = c * F.lit(k / n)
        chi = (p - expected) ** 2 / (expected * (1 - F.lit(k / n)) * (1 - c / F.lit(n)) + 1e-9)
        best = counts.filter(c > 0).orderBy(chi.desc(), "feature").limit(FEATURES // len(labels))
        chosen |= dict.fromkeys(r["feature"] for r in best.select("feature").collect())
    return list(chosen)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None) -> Chain:
    """A chain fitted on at most SAMPLE_ROWS labelled documents. Rows with a null id, text or last label are no examples.

    ``categories`` maps names to 0/1 labels over the columns of ``labels``, in the order of the chain; the last one decides.
    """
    if categories is None:
        there = [c for c in CHAIN if c in labels.columns]
        categories = {f"low_{c}" if c in GOOD else c: 1 - F.col(c).cast("int") if c in GOOD else F.col(c).cast("int") for c in there}
    ys = [f"__y{i}" for i in range(len(categories))]
    last = ys[-1]
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(c).alias(y) for y, c in zip(ys, categories.values(), strict=True)]).filter(F.col(last).isNotNull())
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(features=[sorted(features(t)) for t in pdf["text"]])

    # the sample has at most SAMPLE_ROWS rows of a few numbers
    joined = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id")
    # copies of an id fold before they shuffle; one text of each stays, whichever rows came first
    joined = joined.groupBy("doc_id", *ys).agg(F.min("text").alias("text"))
    # copies of a text share a fold, so none is predicted by a model that has seen it
    folds = joined.select(*ys, F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    sample = cut(folds.mapInPandas(run, folds.drop("text").withColumn("features", F.array(F.lit(""))).schema), "toxicity")
    chosen = choose(sample, ys)
    at = {f: i for i, f in enumerate(chosen)}
    own = F.filter("features", lambda f: f.isin(*chosen)) if chosen else F.array().cast("array<string>")
    rows = [(r["fold"], sorted(at[f] for f in r["own"]), [r[y] for y in ys]) for r in sample.select("fold", own.alias("own"), *ys).collect()]
    return fit(sorted(rows, key=lambda r: (r[0], r[1], [-1 if y is None else y for y in r[2]])), tuple(categories), chosen)


def score(docs: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per input row: ``keep``, a probability p_<category> for each category, and toxic (boolean). Null text is empty."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Chain = sent.value
        for pdf in batches:
            p = model.chances(pdf["__text"].tolist())
            yield pdf.drop(columns="__text").assign(**{c: p[:, i] for i, c in enumerate(names)}, toxic=p[:, -1] >= model.limit)

    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = src.drop("__text").withColumns({c: F.lit(0.0) for c in names} | {"toxic": F.lit(True)}).schema
    return src.mapInPandas(run, schema)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, a probability p_<category> along the chain (p_low_quality, p_toxic) and toxic for every row of ``docs``; without labelled positives nothing is toxic."""
    return score(docs, train(docs, labels))


def remove_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the chain calls toxic; one narrow pass, no shuffle of texts."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.chances(texts.tolist())[:, -1] >= sent.value.limit)

    return docs.filter(~toxic(F.coalesce(F.col(text), F.lit(""))))
