"""Benchmark decontamination by training suffix arrays.

Each shard of training documents (one Arrow batch, in pieces of bounded size) becomes one array of word
numbers and its suffix array. Every suffix of every benchmark item is binary-searched in it; the run of
equal prefixes gives the places, and places that continue each other on one diagonal give the longest
verbatim matches. Shards need no shuffle, so documents never leave their partition.

The benchmark is sent to the tasks in blocks of bounded size; when it needs more than one block, the
shards are searched once for each block and the matches of a document are merged. An item longer than a block
goes into several, which overlap by a window less one word, so that no window is lost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicrill.llm.common import ROW, cut, numbered

WINDOW = 10
#: Words of training text in one suffix array; only a single longer document makes a larger one.
SHARD_WORDS = 1_000_000
#: Words of the benchmark that are sent to the tasks at once.
BLOCK_WORDS = 2_000_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII letters in lower case, everything between words a space.
TABLE = bytes(b if b in _KEEP else b + 32 if b in _UPPER else 32 for b in range(256))

MATCH = "array<struct<item_id:string,item_start:long,doc_start:long,length:long>>"
SPAN = "array<struct<start:long,stop:long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class Tests:
    """Suffixes of one block of benchmark items (id, place of the first word in the item, words), equal windows folded."""

    def __init__(self, items: list[tuple[str, int, list[bytes]]], window: int):
        number: dict[bytes, int] = {}
        self.items = [i for i, _, _ in items]
        self.ahead = np.array([a for _, a, _ in items], np.int64)
        flat, self.start, length = [], [], []
        for _, _, ws in items:
            self.start.append(len(flat))
            length.append(len(ws))
            flat += [number.setdefault(w, len(number)) for w in ws]
        self.words = list(number)
        self.flat = np.array(flat, np.int64)
        places = [(i, k, min(n, window)) for i, n in enumerate(length) for k in range(max(0, n - window) + 1 if n else 0)]
        self.item, self.offset, self.size = (np.array([p[k] for p in places], np.int64) for k in range(3))
        begin = np.array(self.start, np.int64)[self.item] + self.offset if places else np.zeros(0, np.int64)
        grid = np.full((len(places), window), -1, np.int64)
        for k in range(window):
            has = self.size > k
            grid[has, k] = self.flat[begin[has] + k]
        self.grid, self.of = (np.unique(grid, axis=0, return_inverse=True)) if places else (grid, np.zeros(0, np.int64))
        self.of = np.asarray(self.of).reshape(-1)
        self.grid_size = (self.grid >= 0).sum(axis=1)
        # places of each window
        self.by = np.argsort(self.of, kind="stable")
        self.first = np.searchsorted(self.of[self.by], np.arange(len(self.grid) + 1))


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of x, sorted by their first ``depth`` numbers or more; an end sorts first. x is dense from 1.

    Prefix doubling: after each round, suffixes are ordered by twice as many numbers, and only those that are
    still equal to a neighbour are sorted again.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    new = np.r_[True, x[order][1:] != x[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    known = 1
    while known < depth:
        last = np.r_[new[1:], True]
        open_ = np.flatnonzero(~(new & last))
        if not len(open_):
            break
        at = order[open_]
        following = np.where(at + known < n, rank[np.minimum(at + known, n - 1)], 0)
        key = rank[at] * (n + 2) + following
        again = np.argsort(key, kind="stable")
        order[open_] = at[again]
        key = key[again]
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[open_] = fresh
        rank[order[open_]] = np.maximum.accumulate(np.where(fresh, open_, 0)) + 1
        known *= 2
    return order


def search(x: np.ndarray, order: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``grid`` (numbers, -1 past the end) the range of ``order`` whose suffixes begin with it."""
    n = len(x)
    low, high = np.zeros(len(grid), np.int64), np.full(len(grid), n, np.int64)
    padded = np.r_[x, np.zeros(grid.shape[1], x.dtype)]
    for k in range(grid.shape[1]):
        live = np.flatnonzero((grid[:, k] >= 0) & (low < high))
        if not len(live):
            break
        want = grid[live, k]
        for side in (0, 1):
            a, b = low[live].copy(), high[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                seen = padded[order[np.minimum(mid, n - 1)] + k]
                right = open_ & ((seen < want) if side == 0 else (seen <= want))
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            if side == 0:
                start = a
            else:
                low[live], high[live] = start, a
    return low, high


def shard_matches(texts: list[list[bytes]], tests: Tests, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, unique windows, places in the document) of all occurrences, document by document."""
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.r_[0, np.cumsum(lengths + 1)]
    x = np.zeros(starts[-1], np.int64)  # 0 ends a document
    for t, s, n in zip(texts, starts.tolist(), lengths.tolist(), strict=False):
        x[s : s + n] = np.fromiter(map(number.__getitem__, t), np.int64, n)
    known = np.fromiter((number.get(w, -2) for w in tests.words), np.int64, len(tests.words))
    grid = np.where(tests.grid >= 0, known[tests.grid], -1)
    low, high = np.zeros(len(grid), np.int64), np.zeros(len(grid), np.int64)
    there = (grid != -2).all(axis=1)
    if there.any():
        order = suffix_array(x, window)
        low[there], high[there] = search(x, order, grid[there])
    found = np.flatnonzero(high > low)
    if not len(found):
        return
    counts = (high - low)[found]
    which = np.repeat(found, counts)
    at = order[np.repeat(low[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
    doc = np.searchsorted(starts, at, side="right") - 1
    by = np.lexsort((which, at))
    which, at, doc = which[by], at[by], doc[by]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=True):
        yield int(doc[a]), which[a:b], at[a:b] - starts[doc[a]]


def _longest(tests: Tests, which: np.ndarray, place: np.ndarray) -> list[tuple[str, int, int, int]]:
    """Longest verbatim matches: occurrences of neighbouring windows on one diagonal of (item, document) run together."""
    counts = tests.first[which + 1] - tests.first[which]
    rows = tests.by[np.repeat(tests.first[which], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
    doc_at, item, size = np.repeat(place, counts), tests.item[rows], tests.size[rows]
    item_at = tests.offset[rows] + tests.ahead[item]
    by = np.lexsort((item_at, doc_at - item_at, item))
    doc_at, item, item_at, size = doc_at[by], item[by], item_at[by], size[by]
    joined = (item[1:] == item[:-1]) & (doc_at[1:] - item_at[1:] == doc_at[:-1] - item_at[:-1]) & (item_at[1:] <= item_at[:-1] + 1)
    head = np.flatnonzero(np.r_[True, ~joined])
    tail = np.r_[head[1:] - 1, len(item) - 1]
    return [(tests.items[item[h]], int(item_at[h]), int(doc_at[h]), int(item_at[t] + size[t] - item_at[h])) for h, t in zip(head.tolist(), tail.tolist(), strict=True)]


def _union(which: np.ndarray, place: np.ndarray, tests: Tests) -> list[tuple[int, int]]:
    """Spans of document words inside occurrences, joined where they touch; ``place`` ascends."""
    stop = np.maximum.accumulate(place + tests.grid_size[which])
    head = np.flatnonzero(np.r_[True, place[1:] > stop[:-1]])
    tail = np.r_[head[1:] - 1, len(place) - 1]
    return list(zip(place[head].tolist(), stop[tail].tolist(), strict=True))


def _shards(texts: pd.Series, n_words: np.ndarray | None = None) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Places and words of the texts with words, in shards of about SHARD_WORDS; ``n_words`` gets every text's count."""
    rows, shard, size = [], [], 0
    for k, text in enumerate(texts):
        ws = words_of(text)
        if n_words is not None:
            n_words[k] = len(ws)
        if ws:
            rows.append(k)
            shard.append(ws)
            size += len(ws)
        if size >= SHARD_WORDS:
            yield rows, shard
            rows, shard, size = [], [], 0
    if rows:
        yield rows, shard


def _scan(docs: DataFrame, sent: Broadcast, window: int, matches: bool) -> DataFrame:
    keep = [c for c in docs.columns if c != "__bytes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests: Tests = sent.value
        for pdf in batches:
            n_words = np.zeros(len(pdf), np.int64)
            spans: list[list] = [[] for _ in range(len(pdf))]
            items: list[list] = [[] for _ in range(len(pdf))]
            found: list[list] = [[] for _ in range(len(pdf))]
            for rows, texts in _shards(pdf["__bytes"], n_words):
                for d, which, place in shard_matches(texts, tests, window):
                    k = rows[d]
                    spans[k] = _union(which, place, tests)
                    seen = np.unique(which)
                    sizes = tests.first[seen + 1] - tests.first[seen]
                    at = np.repeat(tests.first[seen], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    items[k] = sorted({tests.items[i] for i in np.unique(tests.item[tests.by[at]]).tolist()})
                    if matches:
                        found[k] = _longest(tests, which, place)
            out = pdf[keep].assign(n_words=n_words, __spans=[[{"start": a, "stop": b} for a, b in s] for s in spans], __items=items)
            if matches:
                out["matches"] = [[dict(zip(("item_id", "item_start", "doc_start", "length"), m, strict=True)) for m in f] for f in found]
            yield out

    schema = docs.drop("__bytes").withColumns({"n_words": F.lit(0).cast("long"), "__spans": F.lit(None).cast(SPAN), "__items": F.lit(None).cast("array<string>")} | ({"matches": F.lit(None).cast(MATCH)} if matches else {}))
    return docs.mapInPandas(run, schema.schema)


def blocks(benchmark: DataFrame, item_col: str, text: str, window: int) -> Iterator[Tests]:
    """The benchmark's items in blocks of BLOCK_WORDS words at most, one at a time; nulls and items without words are left out.

    An item of more words goes into several blocks, each from window - 1 words before the last one's end.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text).cast("binary").alias("bytes")).filter("item is not null and bytes is not null")
    most = max(BLOCK_WORDS, 2 * window)
    some, size, any_yet = [], 0, False
    for r in items.toLocalIterator():
        words, at = words_of(bytes(r["bytes"])), 0
        if some and size + len(words) > most:
            yield Tests(some, window)
            some, size, any_yet = [], 0, True
        while len(words) - at > most:
            yield Tests([(r["item"], at, words[at : at + most])], window)
            any_yet, at = True, at + most - window + 1
        if words:
            some.append((r["item"], at, words[at:]))
            size += len(words) - at
    if some or not any_yet:
        yield Tests(some, window)


def _merged(matches: list[dict]) -> list[dict]:
    """Matches of one document over several blocks: parts of one match lie on one diagonal and overlap."""
    out: list[dict] = []
    for m in sorted(matches, key=lambda m: (m["item_id"], m["doc_start"] - m["item_start"], m["item_start"], m["length"])):
        if out and (o := out[-1])["item_id"] == m["item_id"] and o["doc_start"] - o["item_start"] == m["doc_start"] - m["item_start"] and m["item_start"] <= o["item_start"] + o["length"]:
            o["length"] = max(o["length"], m["item_start"] + m["length"] - o["item_start"])
        else:
            out.append(dict(m))
    return out


def locate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, matches: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, columns of ``keep``, n_words, n_hit, item_ids (sorted as strings) and, if asked, matches.

    ``matches`` has the longest verbatim matches of at least one window: item_id, item_start, doc_start, length (words).
    Null and wordless texts have no words and no hits; benchmark items without words or id match nothing; items of
    equal text all match; repeated rows and ids stay apart. Empty tables give no rows, or rows without hits.
    """
    parts = blocks(benchmark, item_col, item_text, window)
    first, second = next(parts), next(parts, None)
    src = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text).cast("binary").alias("__bytes"))
    context = docs.sparkSession.sparkContext
    if second is None:
        found = _scan(src, context.broadcast(first), window, matches)
    else:
        src = cut(numbered(src), "decontaminate")
        each = []
        for part in chain((first, second), parts):
            sent = context.broadcast(part)
            each.append(cut(_scan(src, sent, window, matches), "decontaminate-block"))
            sent.destroy()
        both = each[0]
        for x in each[1:]:
            both = both.unionByName(x)
        gathered = [F.first(c).alias(c) for c in ("doc_id", *keep, "n_words")] + [F.flatten(F.collect_list(c)).alias(c) for c in ("__spans", "__items", *(["matches"] * matches))]
        found = both.groupBy(ROW).agg(*gathered).withColumns({"__items": F.sort_array(F.array_distinct("__items")), "__spans": F.sort_array("__spans")})
        if matches:
            merge = F.pandas_udf(lambda column: column.map(lambda m: _merged(list(m))), MATCH)
            found = found.withColumn("matches", merge("matches"))
    reached = F.aggregate("__spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("stop")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["stop"]))).alias("n"), F.greatest(x["stop"], s["stop"]).alias("stop")))
    return found.select("doc_id", *keep, "n_words", reached["n"].alias("n_hit"), F.col("__items").alias("item_ids"), *(["matches"] * matches))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and digests of locate() for each document, and its longest verbatim match with both places.

    longest (words; 0 without a match), longest_item, longest_item_start, longest_doc_start: of equally long matches the
    first in the document, then the first item. n_matches counts all matches of a window or more (shorter items: whole).
    """
    found = locate(docs, benchmark)
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["length"]).alias("less"), m["doc_start"].alias("doc_start"), m["item_id"].alias("item_id"), m["item_start"].alias("item_start"))))
    return found.withColumn("best", best).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_matches"),
        F.coalesce(-F.col("best.less"), F.lit(0).cast("long")).alias("longest"),
        F.col("best.item_id").alias("longest_item"),
        F.col("best.item_start").alias("longest_item_start"),
        F.col("best.doc_start").alias("longest_doc_start"),
    )


def remove_affected(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold any window of the benchmark; one narrow pass for each block, no shuffle of texts.

    Of several blocks each pass is written to the shared folder, so that one block at a time is held by the tasks.
    """
    context = docs.sparkSession.sparkContext
    clean = lambda df, sent: df.filter(~_affected(sent, window)(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    parts = blocks(benchmark, item_col, item_text, window)
    first, second = next(parts), next(parts, None)
    if second is None:
        return clean(docs, context.broadcast(first))
    for part in chain((first, second), parts):
        sent = context.broadcast(part)
        docs = cut(clean(docs, sent), "decontaminate-clean")
        sent.destroy()
    return docs


def _affected(sent: Broadcast, window: int):
    @F.pandas_udf("boolean")
    def affected(texts: pd.Series) -> pd.Series:
        hit = np.zeros(len(texts), bool)
        for rows, words in _shards(texts):
            for d, _, _ in shard_matches(words, sent.value, window):
                hit[rows[d]] = True
        return pd.Series(hit)

    return affected
