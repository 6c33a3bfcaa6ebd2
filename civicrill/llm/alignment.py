"""Alignment of two tokenizers over the same texts, by the byte ranges of their tokens.

The ends of the B tokens of a batch of texts form one sorted array, a static interval index: the B tokens that
overlap an A token are those from a bisection by its start to one by its end. Bytes at which no token of either side
goes on are never spanned; these gaps are the boundaries of groups. The links of a text, as id pairs, are kept
with their numbers; how many documents of the corpus hold a pair is counted by Spark. The HOT_PAIRS most frequent
pairs reach every task; links of the others meet their counts in a join on the pair.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civicrill.llm.bpe import BEYOND_STABLE, batches_of, byte_alphabet
from civicrill.llm.common import ROW, cut, numbered

#: Pairs that every task gets, the most frequent ones; 16 bytes each.
HOT_PAIRS = 2_000_000
#: Half the range of 32-bit integers is enough for a pair of ids where B has this many at most.
B_IDS = 1 << 15
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_BYTE = regex.compile(r"<0x([0-9A-F]{2})>").fullmatch


class ByteLevel:
    """The byte-level vocabulary of a tokenizers file: ids of space + text, and the bytes of each id."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number = {c: b for b, c in enumerate(byte_alphabet())}
        ids: dict[str, int] = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in ids.items():
            self.bytes[i] = token.encode() if token in special else bytes(number[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        plain = {b: i for i, b in enumerate(self.bytes) if i not in special.values()}
        self.merges = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=plain, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Beyond the characters whose classes are alike everywhere the file's own library splits and merges."""
        return [self.library.encode(" " + t, add_special_tokens=False).ids if BEYOND_STABLE(t) else self.merges.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """The vocabulary of a sentencepiece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(m[1], 16)]) if (m := _BYTE(n)) else n.replace("▁", " ").encode() for n in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Tokens, links and groups of batches of texts."""

    def __init__(self, a: ByteLevel, b: Pieces):
        if len(b.bytes) > B_IDS or len(a.bytes) * B_IDS >= 1 << 31:
            raise ValueError("pairs of these vocabularies do not fit 32 bits")
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in v.bytes], np.int64) for v in (a, b)]
        self.joined = [np.frombuffer(b"".join(v.bytes), np.uint8) for v in (a, b)]
        # what stands in a digest for each id: followed by more tokens of its side, or last of its side in the group
        self.shown = [f"{i}{e}".encode() for v, last in ((a, "|"), (b, ";")) for i in range(len(v.bytes)) for e in (",", last)]

    def spelt(self, side: int, ids: np.ndarray) -> np.ndarray:
        """Bytes of a row of ids."""
        sizes = self.sizes[side][ids]
        before = np.cumsum(self.sizes[side]) - self.sizes[side]
        return self.joined[side][np.repeat(before[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts in a row and the tokens of each, of both sides; none where the bytes of either are not those of space + text."""
        own = [(" " + t).encode() if t else b"" for t in texts]
        whole, lengths = np.frombuffer(b"".join(own), np.uint8), list(map(len, own))
        ids = [self.a.encode(texts), self.b.encode(texts)]

        def faithful(side: int) -> bool:
            flat, sizes = self._flat(ids[side])
            spelt, ends = self.spelt(side, flat), np.r_[0, np.cumsum(self.sizes[side][flat])][np.cumsum(sizes)]
            return len(spelt) == len(whole) and bool((spelt == whole).all()) and bool((ends == np.cumsum(lengths)).all())

        if not (faithful(0) and faithful(1)):
            for i, raw in enumerate(own):
                if any(self.spelt(side, np.array(ids[side][i], np.int64)).tobytes() != raw for side in (0, 1)):
                    ids[0][i], ids[1][i] = [], []
        return [self._flat(x) for x in ids]

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """FIGURES, digest of the groups, distinct pairs and the links of each, for each text."""
        (ids_a, of_a), (ids_b, of_b) = self.tokens(texts)
        ends_a, ends_b = np.cumsum(self.sizes[0][ids_a]), np.cumsum(self.sizes[1][ids_b])
        starts_a, starts_b = ends_a - self.sizes[0][ids_a], ends_b - self.sizes[1][ids_b]
        # B tokens first to last overlap an A token: the first that ends after its start, the last that starts before its end
        first = np.searchsorted(ends_b, starts_a, side="right")
        last = np.searchsorted(starts_b, ends_a, side="left")
        many = last - first
        link_a = np.repeat(np.arange(len(ids_a)), many)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        pairs = ids_a[link_a] * B_IDS + ids_b[link_b]
        # an end is a boundary where no token of the other side goes on
        stop_a = np.zeros(len(ids_a), bool)
        if len(ids_b):
            stop_a = ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a
        borders = ends_a[stop_a]
        group_a, group_b = np.searchsorted(borders, ends_a), np.searchsorted(borders, ends_b)
        through_b = np.searchsorted(group_b, np.arange(len(borders)))
        through_a = np.searchsorted(group_a, np.arange(len(borders)), side="right")
        stop_b = np.r_[group_b[1:] != group_b[:-1], True] if len(ids_b) else np.zeros(0, bool)
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ids_a)) + through_b[group_a]] = ids_a * 2 + stop_a
        code[np.arange(len(ids_b)) + through_a[group_b]] = len(self.a.bytes) * 2 + ids_b * 2 + stop_b
        shown = list(map(self.shown.__getitem__, code.tolist()))
        in_a, in_b = np.r_[0, np.cumsum(of_a)].tolist(), np.r_[0, np.cumsum(of_b)].tolist()
        groups, links = np.r_[0, np.cumsum(stop_a)], np.r_[0, np.cumsum(many)]
        for i in range(len(texts)):
            n_a, n_b = in_a[i + 1] - in_a[i], in_b[i + 1] - in_b[i]
            some, counts = np.unique(pairs[links[in_a[i]] : links[in_a[i + 1]]], return_counts=True)
            digest = hashlib.sha256(b"".join(shown[in_a[i] + in_b[i] : in_a[i + 1] + in_b[i + 1]])[:-1]).hexdigest() if n_a else ""
            yield n_a, n_b, int(groups[in_a[i + 1]] - groups[in_a[i]]), int(counts.sum()), digest, some.astype(np.int32), counts.astype(np.int32)

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


def aligned(docs: DataFrame, a: tuple[str, str], b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ROW, FIGURES, groups_sha256, and pairs and times: the linked id pairs of a text (A id x B_IDS + B id), and how often.

    ``a`` is a byte-level tokenizers file and its splitting pattern, ``b`` a sentencepiece model with byte fallback. A
    text that is null, empty or whose tokens do not give back its bytes has no tokens: zeros and empty values.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(ByteLevel(*a), Pieces(b))
        for pdf in batches:
            at = 0
            for some in batches_of(pdf["__text"].tolist()):
                rows = pdf.iloc[at : at + len(some)].drop(columns="__text")
                at += len(some)
                yield rows.assign(**dict(zip((*FIGURES, "groups_sha256", "pairs", "times"), map(list, zip(*aligner.align(some), strict=True)), strict=True)))

    src = numbered(docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")))
    kinds = dict.fromkeys(FIGURES, "long") | {"groups_sha256": "string", "pairs": "array<int>", "times": "array<int>"}
    return src.mapInPandas(run, src.drop("__text").withColumns({k: F.lit(None).cast(v) for k, v in kinds.items()}).schema)


def counted(links: DataFrame) -> DataFrame:
    """(pair, n, best): documents of the corpus that hold a pair, and whether no pair of its A id is held by more."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.withColumn("a", F.floor(F.col("pair") / B_IDS).cast("int")), "pairs")
    # a row for each id of the A vocabulary at most
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int) -> tuple[int, pd.DataFrame]:
    """The smallest power of two that at most ``most`` pairs' counts reach, and these pairs."""
    level = F.floor(F.log2("n")).cast("int")
    least, held = 64, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("level")).collect():
        held += r["pairs"]
        if held > most:
            break
        least = r["level"]
    return 1 << least if least < 63 else (1 << 63) - 1, counts.filter(level >= least).toPandas().sort_values("pair")


def with_counts(links: DataFrame, counts: DataFrame, most: int = HOT_PAIRS) -> DataFrame:
    """``links`` (from aligned, cut) with n_best and count_sum in place of pairs and times."""
    least, hot = frequent(counts, most)
    sent = links.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n, best = sent.value
        for pdf in batches:
            sizes = pdf["pairs"].map(len).to_numpy(np.int64)
            row = np.repeat(np.arange(len(pdf)), sizes)
            pairs, times = (np.concatenate([*pdf[c], np.zeros(0, np.int32)]).astype(np.int64) for c in ("pairs", "times"))
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            there = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            at, own = at[there], row[there]
            sums = [np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)]
            if len(own):
                np.add.at(sums[0], own, times[there] * best[at])
                np.add.at(sums[1], own, times[there] * n[at])
            rest, cuts = np.flatnonzero(~there), np.searchsorted(row[~there], np.arange(1, len(pdf)))
            cold = [np.split(x[rest].astype(np.int32), cuts) for x in (pairs, times)] if len(pdf) else [[], []]
            yield pdf.drop(columns=["pairs", "times"]).assign(__best=sums[0], __sum=sums[1], __pairs=cold[0], __times=cold[1])

    kinds = {"__best": "long", "__sum": "long", "__pairs": "array<int>", "__times": "array<int>"}
    schema = links.drop("pairs", "times").withColumns({k: F.lit(None).cast(v) for k, v in kinds.items()}).schema
    done = links.mapInPandas(run, schema)
    if not least > 1:  # every pair has reached the tasks
        return done.withColumnsRenamed({"__best": "n_best", "__sum": "count_sum"}).drop("__pairs", "__times")
    done = cut(done, "counted")
    cold = done.select(ROW, F.explode(F.arrays_zip("__pairs", "__times")).alias("x")).select(ROW, F.col("x.__pairs").alias("pair"), F.col("x.__times").alias("times"))
    cold = cold.join(counts.filter(F.col("n") < least), "pair")
    more = cold.groupBy(ROW).agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
    both = [(F.col(own) + F.coalesce(F.col(x), F.lit(0))).alias(name) for own, x, name in (("__best", "b", "n_best"), ("__sum", "s", "count_sum"))]
    return done.join(more, ROW, "left").select(*links.drop("pairs", "times").columns, *both)


def report(docs: DataFrame, a: tuple[str, str], b: str, text: str = "text", most: int = HOT_PAIRS) -> DataFrame:
    """doc_id, FIGURES, n_best, count_sum and groups_sha256 of every row; repeated rows count as documents of their own."""
    links = cut(aligned(docs, a, b, text), "links")
    found = with_counts(links, counted(links), most)
    return found.select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256")
