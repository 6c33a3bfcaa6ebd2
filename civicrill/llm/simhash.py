"""SimHash near-duplicates by pigeonhole blocks.

The 64 bits are split into six blocks; two fingerprints that differ in at most three bits agree on at
least three of the six, so each of the 20 choices of three blocks gives one join key of about 32 bits.
Equal fingerprints are folded first. A key's bucket is compared inside bounded pieces (large buckets as
pairs of sub-blocks), and a piece emits one pair for each member of a component, never all its pairs: every link
inside a piece is verified, and components need no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicrill.llm.common import cut

BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
MAX_BITS = 3
#: Fingerprints of one sub-block of a bucket; a piece holds two sub-blocks at most.
PIECE = 2048
#: Keys of dropped rows (about 100 bytes each in a task) that are sent to the tasks at most; more of them are joined by a shuffle.
SENT_KEYS = 500_000


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash over 3-word shingles, repeats included; 0 for null or wordless text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= 3 else iter([b" ".join(words)])
    n = max(1, len(words) - 2)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        votes += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` without its text, plus the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.fromiter(map(fingerprint, pdf["__bytes"]), np.uint64, len(pdf))
            yield pdf[keep].assign(**{out: fp.view(np.int64)})

    src = docs.select(*keep, F.col(text).cast("binary").alias("__bytes"))
    return src.mapInPandas(run, src.drop("__bytes").withColumn(out, F.lit(0).cast("long")).schema)


def _key(fp: Column, blocks: tuple[int, ...], nth: int) -> Column:
    parts, width = [], 0
    for b in blocks:
        start, bits = BLOCKS[b]
        parts.append(F.shiftleft(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << bits) - 1)), width))
        width += bits
    return reduce(Column.bitwiseOR, parts).bitwiseOR(F.lit(nth << 40))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each piece, the components that verified links make of its fingerprints: (a, b) with b the least member of a's component."""
    for pdf in batches:
        out: list[np.ndarray] = []
        for fps in pdf["fps"]:
            x = np.sort(np.asarray(fps, np.int64))
            u, root = x.view(np.uint64), np.arange(len(x))
            left = np.arange(len(x))
            while len(left):  # breadth-first: each member joins a component once, so a piece emits n - 1 links at most
                wave, left = left[:1], left[1:]
                head = wave[0]
                while len(wave) and len(left):
                    reached = np.zeros(len(left), bool)
                    for k in range(0, len(wave), 256):
                        reached |= (np.bitwise_count(u[wave[k : k + 256], None] ^ u[None, left]) <= MAX_BITS).any(axis=0)
                    wave, left = left[reached], left[~reached]
                    root[wave] = head
            linked = root != np.arange(len(x))
            out.append(np.stack([x[linked], x[root[linked]]], axis=1))
        both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (member, least member of its component in a piece) of the distinct fingerprints in column fp; together they connect exactly what links of 3 bits connect."""
    keys = F.array(*[_key(F.col("fp"), c, i) for i, c in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS))])
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    buckets = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1"), "simhash-buckets")
    two = buckets.filter((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= MAX_BITS)).select(F.col("hi").alias("a"), F.col("lo").alias("b"))
    parts = F.ceil(F.col("n") / PIECE).cast("int")
    own = F.pmod(F.xxhash64("fp", "key"), parts).cast("int")
    pieces = (
        rows.join(buckets.filter("n > 2").select("key", "n"), "key")
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    return two.unionByName(pieces.select("fps").mapInPandas(_forest, "a long, b long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of the component.

    Alternating large-star and small-star steps, each written to the shared folder; a logarithmic number of rounds.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "components")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        now = cut(small, "components")
        was, seen = seen, mark(now)
        if was == seen:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, fp (signed long), fingerprint (hex), component_id (smallest id reachable).

    Null text counts as empty (fingerprint zero). Null ids keep their row and never name a component unless all
    its ids are null. Repeated rows and ids stay as they are. Other columns are ignored. Empty in, empty out.
    """
    marked = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))), "simhash")
    folded = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = cut(folded, "simhash-distinct")
    roots = cut(components(links(distinct)), "simhash-roots").withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(member, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the smallest id (null last); of equal ids and texts, any one row.

    Rows are known by a 128-bit digest of id and text. The keys of what goes are few where copies are; their number is
    taken before they are sent to the tasks, and then no text is shuffled.
    """
    key = F.md5(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("null"))))
    marked = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), key.alias("__key"), F.col(text).alias("text"))), "simhash")
    distinct = cut(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    keep = cut(named.select(F.col("first.__key").alias("__key")), "simhash-keep")
    counted = marked.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).join(keep.withColumn("kept", F.lit(True)), "__key", "left")
    # what goes, and what stays once of several equal rows
    special = cut(counted.filter("kept is null or n > 1").select("__key", F.col("kept").isNotNull().alias("kept")), "simhash-special")
    sent = lambda df: F.broadcast(df) if df.count() <= SENT_KEYS else df
    keyed = docs.withColumn("__key", key)
    single = keyed.join(sent(special), "__key", "left_anti").drop("__key")
    again = special.filter("kept")
    return single if again.isEmpty() else single.unionByName(keyed.join(sent(again), "__key", "left_semi").dropDuplicates(["__key"]).drop("__key"))
