"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is parsed from left to right into the longest
phrases that the language's text holds; a phrase costs the logarithm of the length of that text. The language whose
phrases cost least in all is the prediction. Many texts walk all automata together, a symbol at a time, in numpy.

Learning reads a bounded sample (SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_CHARS, LANGUAGES); every text is parsed whole.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicrill.llm.common import cut
from civicrill.operators.keyed import top_k

#: Different texts of a language in the sample, the first by hash, and characters of each.
SAMPLE_ROWS, SAMPLE_TEXT = 200, 4_000
#: Symbols of all languages' automata together; languages share them evenly. Bounds the memory of the automata.
SAMPLE_CHARS = 320_000
#: Languages at most, those of the most different texts.
LANGUAGES = 64
#: Symbols: 0 stands for all that is no letter, 1 for letters that no language has often; then the most frequent letters.
LETTERS = 94
#: Texts that walk together; fewer are walked one by one, which is then quicker.
TOGETHER = 24
#: Symbols of texts that one batch holds.
CHUNK = 8_000_000
UNDETERMINED = "und"
PARTS, HELD = 4, 2


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from; false for a null id, which is not learned from either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(PARTS)) == HELD, F.lit(False))


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``symbols``, state 0 first."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


@dataclass
class Languages:
    """Automata of all languages in one table.

    ``steps[state + symbol]`` is the state after a symbol times four, plus the phrases that end before it (0 to 2: one
    where the walk starts anew, one more for a symbol that the language has not). States are offsets into the table.
    """

    names: list[str]
    symbol: np.ndarray
    width: int
    #: Root of each language and the end of the last one; then places and values of the steps that do not start anew.
    roots: np.ndarray
    at: np.ndarray
    to: np.ndarray
    costs: np.ndarray

    def __post_init__(self) -> None:
        self.steps = np.zeros(int(self.roots[-1]), np.int32)
        for r, end in zip(self.roots[:-1].tolist(), self.roots[1:].tolist(), strict=True):
            root = np.full(self.width, r * 4 + 1, np.int32)
            own = slice(*np.searchsorted(self.at, [r, r + self.width]))
            root[self.at[own] - r] = self.to[own]
            self.steps[r:end] = np.tile(root + 1, (end - r) // self.width)
            self.steps[r : r + self.width] = root
        self.steps[self.at] = self.to

    def __reduce__(self) -> tuple:
        """Tasks get the transitions alone and build the table, which is some ten times as large."""
        return Languages, (self.names, self.symbol, self.width, self.roots, self.at, self.to, self.costs)

    def symbols(self, text: str) -> np.ndarray:
        """Letters folded to lower case, each run of other characters as one 0, none at the ends."""
        found = self.symbol[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
        gap = found == 0
        if gap.any():
            found = found[~gap | np.r_[False, ~gap[:-1]]]
            found = found[:-1] if len(found) and not found[-1] else found
        return found

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([texts[i] for i in order]).astype(np.int32) if len(texts) else np.zeros(0, np.int32)
        sizes = lengths[order]
        starts = np.r_[0, np.cumsum(sizes)][: len(sizes)]
        state = np.tile(self.roots[:-1], (len(texts), 1))
        count = np.zeros((len(texts), len(self.names)), np.int32)
        done = 0
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        for done, k in enumerate(active.tolist()):  # noqa: B007
            if k < TOGETHER:
                break
            step = self.steps.take(state[:k] + flat[starts[:k] + done][:, None])
            count[:k] += step & 3
            state[:k] = step >> 2
        else:
            done = len(active)
        quick = memoryview(self.steps)
        for i in range(int(active[done]) if done < len(active) else 0):
            rest = flat[starts[i] + done : starts[i] + sizes[i]].tolist()
            for j in range(len(self.names)):
                at, n = int(state[i, j]), int(count[i, j])
                for s in rest:
                    step = quick[at + s]
                    n += step & 3
                    at = step >> 2
                state[i, j], count[i, j] = at, n
        count += state != self.roots[:-1]
        out = np.empty_like(count)
        out[order] = count
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        parsed = [self.symbols(t or "") for t in texts]
        costs = self.phrases(parsed) * self.costs
        out = []
        for text, cost in zip(parsed, costs, strict=True):
            if not len(text) or not len(cost):
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(np.argmin(cost))
            rest = np.delete(cost, best)
            out.append((self.names[best], float(1 - cost[best] / rest.min()) if len(rest) else 1.0))
        return out


def fit(rows: list[tuple[str, str]]) -> Languages:
    """Automata of (language, text) rows; of languages with equal costs the one whose row comes first wins."""
    texts: dict[str, list[str]] = {}
    for lang, text in rows:
        texts.setdefault(lang, []).append(text.lower())
    names = list(texts)
    letters = Counter(c for ts in texts.values() for t in ts for c in t if c.isalpha())
    number = {c: i + 2 for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])}
    symbol = np.zeros(sys.maxunicode + 1, np.uint8)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c.isalpha():
            symbol[code] = number.get(c.lower(), 1)
    width, share = len(number) + 2, SAMPLE_CHARS // max(1, len(names))
    none = np.zeros(0, np.int32)
    alphabet = Languages([], symbol, width, np.zeros(1, np.int32), none, none, np.zeros(0))
    roots, at, to, costs = [0], [], [], []
    for name in names:
        read = [s for t in texts[name] for s in [*alphabet.symbols(t).tolist(), 0]][:share]
        # a letter that the alphabet has no place for is known to no language
        moves = automaton([s for s in read if s != 1])
        base = roots[-1]
        for i, m in enumerate(moves):
            for s in sorted(m):
                at.append(base + i * width + s)
                to.append((base + m[s] * width) * 4)
        roots.append(base + len(moves) * width)
        costs.append(np.log2(len(read) + 1))
    return Languages(names, symbol, width, *(np.array(x, np.int32) for x in (roots, at, to)), np.array(costs))


def sample(docs: DataFrame) -> DataFrame:
    """(lang, texts, h, text): the texts to learn from and how many different ones their language has, at most SAMPLE_ROWS of each of LANGUAGES languages; copies count once."""
    learn = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).filter("lang is not null and text rlike '\\\\p{L}'")
    keyed = cut(learn.select("lang", F.xxhash64("text").alias("h")).distinct(), "language")
    langs = keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")).orderBy(F.desc("texts"), "lang").limit(LANGUAGES)
    picked = top_k(keyed.join(F.broadcast(langs), "lang"), ["lang"], SAMPLE_ROWS, F.col("h")).drop("rank")
    # LANGUAGES x SAMPLE_ROWS rows of a name and two numbers
    found = learn.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, SAMPLE_TEXT).alias("text")).join(F.broadcast(picked), ["lang", "h"])
    return found.groupBy("lang", "texts", "h").agg(F.min("text").alias("text"))


def train(docs: DataFrame) -> Languages:
    """Automata of the languages named in ``docs``; text and lang of documents that are not held out, nothing else."""
    return fit([(r["lang"], r["text"]) for r in sample(docs).orderBy(F.desc("texts"), "lang", "h").collect()])


def identify(docs: DataFrame, languages: Languages, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, lang_pred and score for every row of ``docs``.

    The score is the share of the second language's cost that the best one saves, 1 where only one language is known. A text
    that is null or has no letter is ``und`` with score 0, as is every text where nothing was learned. Repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, found = pdf["__text"].tolist(), [(UNDETERMINED, 0.0)] * len(pdf)
            # texts of like lengths together, so that few wait for a long one
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
            while order:
                n, size = 0, 0
                while n < len(order) and (not n or size < CHUNK):
                    size += len(texts[order[n]] or "")
                    n += 1
                some, order = order[:n], order[n:]
                for i, x in zip(some, sent.value.predict([texts[i] for i in some]), strict=True):
                    found[i] = x
            yield pdf[list(keep)].assign(lang_pred=[x[0] for x in found], score=[x[1] for x in found])

    src = docs.select(*keep, F.col(text).alias("__text"))
    return src.mapInPandas(run, src.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from the rows of ``docs`` that are not held out."""
    rows = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return identify(rows, train(docs), ("doc_id", "held_out"))
