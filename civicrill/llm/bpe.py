"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of all words that a batch has not met before lie in one flat array. In each round every word
finds its lowest-rank pair by binary search over the sorted pair keys and merges all its places at once;
words without a pair left drop out. Texts are then gathered from the encoded words.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

#: Words whose ids one Python worker remembers between batches; beyond that it starts afresh.
REMEMBERED = 200_000
#: Characters of text that are encoded together.
CHUNK = 4_000_000
NO_RANK = np.iinfo(np.int64).max

#: What the vocabulary file must state; other models need other code.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Characters whose classes are the same in every Unicode version that the libraries carry.
BEYOND_STABLE = regex.compile("[^\\x00-\\u0527]").search


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(shown))
    return [names[b] for b in range(256)]


class Vocabulary:
    """Arrays of one vocabulary file; small, of fixed size, sent to the tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != NORMALIZERS or [x["type"] for x in split] != ["Split", "ByteLevel"] or spec["decoder"] or model["end_of_word_suffix"] != "</w>":
            raise ValueError(f"{path} is no lower-case word-end BPE vocabulary")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.split = split[0]["pattern"]["Regex"]
        self.pattern = split[0]["pattern"]["Regex"].replace("\\s", "\\p{White_Space}")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_alphabet()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + end] for c in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = len(self.tokens)
        keys = np.array([ids[a] * self.base + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and the offsets of the words (one more than words). No word is empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    symbols = v.inner[raw]
    symbols[ends - 1] = v.final[raw[ends - 1]]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_owner = [], []
    while len(symbols):
        pairs = symbols[:-1] * v.base + symbols[1:]
        at = np.minimum(np.searchsorted(v.keys, pairs), len(v.keys) - 1)
        rank = np.full(len(symbols), NO_RANK)
        known = (v.keys[at] == pairs) & (owner[:-1] == owner[1:])
        rank[:-1][known] = v.ranks[at[known]]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.r_[first, len(symbols)])
        best = np.repeat(best, sizes)
        over = best == NO_RANK
        if over.any():
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
            symbols, owner, rank, best = symbols[~over], owner[~over], rank[~over], best[~over]
            if not len(symbols):
                break
        hit = rank == best
        # of adjoining places (as in "aaa") every second one merges, from the left
        places = np.flatnonzero(hit)
        starts = np.r_[True, np.diff(places) > 1]
        run = np.maximum.accumulate(np.where(starts, np.arange(len(places)), 0))
        places = places[(np.arange(len(places)) - run) % 2 == 0]
        symbols[places] = v.merged[rank[places]]
        stay = np.ones(len(symbols), bool)
        stay[places + 1] = False
        symbols, owner = symbols[stay], owner[stay]
    flat, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbols, done_owner))
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return flat[order].astype("<u4"), np.r_[0, np.cumsum(counts)]


class Encoder:
    """Encodes texts in one task; remembers the words it has met."""

    def __init__(self, v: Vocabulary):
        self.v, self.find = v, regex.compile(v.pattern).findall
        self.clean = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex("\\s+"), " "), normalizers.Lowercase()])
        self.split = pre_tokenizers.Split(Regex(v.split), "removed", invert=True)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.shown: list[str] = []
        for token, i in self.v.special.items():
            self.at["\0" + token] = len(self.ids)
            self.ids.append(np.uint32(i).astype("<u4").tobytes())
            self.shown.append(token)

    def words(self, text: str) -> list[str]:
        """Words of a text in order; a special token's word starts with NUL, which no other special word can."""
        if not any(s in text for s in self.v.special):
            return self.plain(text)
        out, rest = [], text
        while rest:
            place, token = min(((i, -len(s), s) for s in self.v.special if (i := rest.find(s)) >= 0), default=(len(rest), 0, ""))[::2]
            out += self.plain(rest[:place])
            if token:
                out.append("\0" + token)
            rest = rest[place + len(token) :]
        return out

    def plain(self, text: str) -> list[str]:
        if BEYOND_STABLE(text):
            # Unicode versions differ in what is a letter, so the library's own splitting decides; the merges stay ours
            return [piece for piece, _ in self.split.pre_tokenize_str(self.clean.normalize_str(text))]
        text = unicodedata.normalize("NFC", text)
        # each character by itself: str.lower() looks at the neighbours of a sigma
        return self.find(text.replace("Σ", "σ").lower())

    def learn(self, words: list[str]) -> None:
        new = list(dict.fromkeys(w for w in words if w not in self.at))
        if not new:
            return
        flat, offsets = encode_words([w.encode() for w in new], self.v)
        names = self.v.tokens
        raw, cuts = flat.tobytes(), (offsets * 4).tolist()
        tokens, ends = [names[i] for i in flat.tolist()], offsets.tolist()
        for k, w in enumerate(new):
            self.at[w] = len(self.ids)
            self.ids.append(raw[cuts[k] : cuts[k + 1]])
            self.shown.append(" ".join(tokens[ends[k] : ends[k + 1]]))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text, of each text."""
        if len(self.ids) > REMEMBERED:
            self.forget()
        split = [self.words(t) for t in texts]
        self.learn([w for ws in split for w in ws])
        for ws in split:
            at = [self.at[w] for w in ws]
            yield b"".join([self.ids[i] for i in at]), " ".join([self.shown[i] for i in at])


def batches_of(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ids (binary, little-endian unsigned 32-bit integers) and decoded (string).

    Null and empty texts give no ids and an empty string. Whole texts are encoded, however long. Repeated rows
    stay; other columns are kept, but ids and decoded of the input are replaced. Empty in, empty out.
    """
    return _run(docs, path, text, {"ids": "binary", "decoded": "string"}, lambda ids, shown: (ids, shown))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """As encode(), with n_tokens and the SHA-256 of ids and of the decoded text in place of both."""
    return _run(docs, path, text, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, lambda ids, shown: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))


def _run(docs: DataFrame, path: str, text: str, fields: dict[str, str], of) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    keep = [c for c in docs.columns if c not in (text, *fields)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(sent.value)
        for pdf in batches:
            rows = [of(*x) for some in batches_of(pdf["__text"].tolist()) for x in encoder.encode(some)]
            new = dict(zip(fields, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(fields, ())
            yield pdf[keep].assign(**{k: pd.Series(x, index=pdf.index, dtype="int64" if fields[k] == "long" else object) for k, x in new.items()})

    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = src.drop("__text")
    for k, kind in fields.items():
        schema = schema.withColumn(k, F.lit(None).cast(kind))
    return src.mapInPandas(run, schema.schema)
