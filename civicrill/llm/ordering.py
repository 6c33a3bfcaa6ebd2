"""Training-order materialisation: token sequences in a keyed random order, as shards of fixed stride.

Documents become sequences of a fixed number of 16-bit token ids. They are numbered densely in the order of ids and
texts, so that a rerun over other files or on more cores gives the same order; a keyed
Feistel permutation with cycle-walking gives each number its slot in the training order, so the order needs no
sort by random keys and any slot can be traced back. Slots are dealt to range partitions, each of which writes
whole shards: slot s lies in shard s // SHARD at byte (s % SHARD) * stride, so readers resume anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicrill.llm.common import ROW, cut, numbered

SEQUENCE, SHARD = 256, 4096
ROUNDS = 6
_IN_PARTITION = 33  # bits of monotonically_increasing_id() that count rows


class Permutation:
    """A keyed permutation of range(n): Feistel rounds over a*b >= n pairs, walking on until the value is below n."""

    def __init__(self, n: int, key: str):
        self.n = n
        self.a = max(1, isqrt(max(0, n - 1)) + 1)
        self.b = max(1, -(-n // self.a))
        self.keys = [int.from_bytes(hashlib.blake2b(f"{key}/{n}/{r}".encode(), digest_size=8).digest(), "little") for r in range(ROUNDS)]

    @staticmethod
    def mix(x: np.ndarray, key: int) -> np.ndarray:
        z = x.astype(np.uint64) ^ np.uint64(key)
        with np.errstate(over="ignore"):
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * (self.mix(left, self.keys[r]) % np.uint64(self.b)).astype(np.int64)) % self.b
            else:
                left = (left + sign * (self.mix(right, self.keys[r]) % np.uint64(self.a)).astype(np.int64)) % self.a
        return left * self.b + right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.int64), back)
        while (over := x >= self.n).any():
            x[over] = self._once(x[over], back)
        return x

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


class BytePairs:
    """Byte-pair ranks of a file, read on the driver and sent to the tasks; ``end`` is the end-of-text id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.end = pattern, len(self.ranks)

    def encoder(self) -> Callable[[str], list[int]]:
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary


def arranged(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text in the order of id and text, range partitions one after the other; equal rows stand in any order, which no reader can tell.

    The number of a row breaks the tie of equal rows, so one id or text with very many rows goes to several partitions.
    """
    keyed = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).withColumn("__digest", F.md5("text"))
    order = ("doc_id", "__digest", ROW)
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def sequences(docs: DataFrame, tokens: BytePairs, length: int = SEQUENCE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk, n_tokens, ids (binary, ``length`` little-endian 16-bit ids): a text's tokens and an end-of-text, the last sequence padded with it.

    Null and empty texts give one sequence of end-of-text alone. Repeated rows give repeated sequences. The rows keep the
    order of ``docs``, which arranged() makes.
    """
    end = tokens.end
    if end >= 1 << 16:
        raise ValueError("ids need more than 16 bits")
    sent = docs.sparkSession.sparkContext.broadcast(tokens)
    stride = 2 * length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = sent.value.encoder()
        for pdf in batches:
            out: list[tuple] = []
            for doc, body in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array(encode(body or ""), "<u2")
                n, parts = len(ids) + 1, -(-(len(ids) + 1) // length)
                whole = np.full(parts * length, end, "<u2")
                whole[: len(ids)] = ids
                raw = whole.tobytes()
                out += [(doc, k, min(length, n - k * length), raw[k * stride : (k + 1) * stride]) for k in range(parts)]
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=["doc_id", "chunk", "n_tokens", "ids"])
                    out = []
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "n_tokens", "ids"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInPandas(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, chunk int, n_tokens int, ids binary")


def in_order(seqs: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(sequences with their slot, number of sequences). The table is written once, which fixes every sequence's number."""
    table = cut(numbered(seqs), "ordering")
    part = F.shiftright(F.col(ROW), _IN_PARTITION).alias("part")
    # one row per partition of the table
    counts = sorted((r["part"], r["n"]) for r in table.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p], total = total, total + n
    first = table.sparkSession.createDataFrame(list(starts.items()), "part long, first long")
    order = Permutation(total, key)

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(order.slot(number.to_numpy()))

    number = F.col("first") + F.col(ROW).bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))
    return table.withColumn("part", part).join(F.broadcast(first), "part").withColumn("slot", slot(number)).drop("part", "first", ROW), total


def shards(seqs: DataFrame, key: str, shard: int = SHARD) -> DataFrame:
    """One row per shard: shard, first_slot, n_sequences, stride, sha256, doc_ids and chunks in slot order, data (the shard's bytes).

    No sequences, no shards.
    """
    placed, total = in_order(seqs, key)
    n_shards = -(-total // shard)
    parts = max(1, min(n_shards, int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    of = F.floor(F.col("slot") / shard)
    dealt = placed.withColumn("shard", of).repartitionById(parts, (F.col("shard") * parts / F.lit(max(1, n_shards))).cast("int")).sortWithinPartitions("slot")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(rest) > shard:
                last = rest["shard"].iloc[-1]
                done, rest = rest[rest["shard"] != last], rest[rest["shard"] == last]
                yield from pack(done)
        if rest is not None:
            yield from pack(rest)

    def pack(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for k, own in pdf.groupby("shard", sort=True):
            data = b"".join(own["ids"])
            yield pd.DataFrame({"shard": [k], "first_slot": [k * shard], "n_sequences": [len(own)], "stride": [len(data) // len(own)], "sha256": [hashlib.sha256(data).hexdigest()], "doc_ids": [own["doc_id"].tolist()], "chunks": [own["chunk"].tolist()], "data": [data]})

    kind = seqs.schema["doc_id"].dataType
    schema = T.StructType.fromDDL("shard long, first_slot long, n_sequences long, stride long, sha256 string").add("doc_ids", T.ArrayType(kind)).add("chunks", T.ArrayType(T.IntegerType())).add("data", T.BinaryType())
    return dealt.mapInPandas(run, schema)


def shard_name(k: int) -> str:
    return f"shard-{k:08d}.bin"


def write_shards(packed: DataFrame, uri: str) -> DataFrame:
    """Write each shard's bytes to ``uri`` (file://, hdfs://, s3:// ...); returns the manifest: all columns but data, and the file.

    A shard is written under another name and then moved, so repeated and speculative tasks leave one whole file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            names = []
            for k, data in zip(pdf["shard"], pdf["data"], strict=True):
                name = f"{base}/{shard_name(k)}"
                with fs.open_output_stream(part := f"{name}.{uuid.uuid4().hex}") as f:
                    f.write(data)
                fs.move(part, name)
                names.append(shard_name(k))
            yield pdf.drop(columns="data").assign(file=names)

    return packed.mapInPandas(run, packed.drop("data").withColumn("file", F.lit("")).schema)


def read_from(fs, base: str, slot: int, total: int, length: int = SEQUENCE, shard: int = SHARD) -> Iterator[np.ndarray]:
    """Sequences from ``slot`` on, read one after another; ``fs`` is a pyarrow file system."""
    stride = 2 * length
    while slot < total:
        k, skip = divmod(slot, shard)
        with fs.open_input_file(f"{base}/{shard_name(k)}") as f:
            f.seek(skip * stride)
            for _ in range(min(shard - skip, total - slot)):
                yield np.frombuffer(f.read(stride), "<u2")
                slot += 1
