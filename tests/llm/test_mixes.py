"""Filter interactions, tokenizer alignment and language identification against brute force, on awkward rows."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_corpus import TEXTS
from tokenizers import Tokenizer

from civicrill.llm import alignment, audit, language

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
MORE = ["ABCDEFG hij", "word " * 250, " ".join(f"w{i}" for i in range(250)), "é" * 60 + "A", "  two  spaces ", "▁ under", "a\x00b", "<s> <unk> <0x41> </s>", "　wide ½ Ⅳ ﬁ é"]


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, one row twice, one id with two texts, a null in every column, and columns that clash with results."""
    texts = [*TEXTS, *MORE, MORE[0], MORE[0], "", None]
    data = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "")[i % 4], 1) for i, t in enumerate(texts)]
    data += [data[5], (5, MORE[1], "en", "a", 1), (None, None, None, None, None), (None, MORE[0], "de", "b", 1), (None, MORE[0], None, None, None)]
    own = dict.fromkeys(("part", "mask", "kept", "n", "pairs", "n_a", "score", "held_out", "digest", "first", "h", "texts"), F.lit("own"))
    return spark.createDataFrame(data, DOCS).withColumns(own).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


LABELS = [(0, 1, 0), (0, None, 1), (1, 0, 1), (7, 1, 1), (25, 1, None), (25, 1, None), (None, 1, 1), (5, 1, 0), (999, 1, 1), (22, None, None)]


def plain_audit(rows, labels):
    base = []
    for r in rows:
        t = r["text"] or ""
        w = BLANK.findall(t)
        smaller = r["doc_id"] is not None and any(x["doc_id"] is not None and x["doc_id"] < r["doc_id"] and (x["text"] or "") == t for x in rows)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": smaller}
        said = [x for x in labels if x[0] is not None and x[0] == r["doc_id"]]
        base.append((r["source"] or "", fails, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out, shapley = {}, collections.Counter()
    for part in {b[0] for b in base}:
        mine = [b for b in base if b[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [b for b in left if b[1][f]]
                left = [b for b in left if not b[1][f]]
                failing = [b for b in mine if b[1][f]]
                only = [b for b in failing if sum(b[1].values()) == 1]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), len(only), sum(b[2] for b in gone), sum(b[3] for b in gone)]
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_interactions(spark, docs):
    got = audit.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(got.columns) == sorted(columns) and len(rows) == len(set(rows)) == 3 * 600
    assert set(rows) == plain_audit([r.asDict() for r in docs.select("doc_id", "text", "source").collect()], LABELS)


def test_interactions_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(empty, none).collect() == []
    assert audit.audit(docs, none).agg(F.sum(F.col("good_lost") + F.col("toxic_lost"))).first()[0] == 0


A, B = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def linked():
    """Plain alignment of one text: ids, groups and links."""
    aligner = alignment.Aligner(alignment.ByteLevel(*A), alignment.Pieces(B))
    library, model = Tokenizer.from_file(A[0]), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True

    def of(t):
        raw = (" " + t).encode() if t else b""
        ids = [library.encode(" " + t, add_special_tokens=False).ids, model.encode(t)] if t else [[], []]
        parts = [[v.bytes[i] for i in x] for v, x in zip((aligner.a, aligner.b), ids, strict=True)]
        if any(b"".join(p) != raw for p in parts):
            return [], [], "", []
        ends = [list(itertools.accumulate(map(len, p))) for p in parts]
        groups, at = [], [0, 0]
        for x in sorted(set(ends[0]) & set(ends[1])):
            upto = [end.index(x, k) + 1 for end, k in zip(ends, at, strict=True)]
            groups.append("|".join(",".join(map(str, own[k:n])) for own, k, n in zip(ids, at, upto, strict=True)))
            at = upto
        links, j = [], 0
        for i, e, p in zip(ids[0], ends[0], parts[0], strict=True):
            while j and ends[1][j - 1] > e - len(p):
                j -= 1
            while j < len(ids[1]) and ends[1][j] - len(parts[1][j]) < e:
                if ends[1][j] > e - len(p):
                    links.append((i, ids[1][j]))
                j += 1
        return ids[0], ids[1], ";".join(groups), links

    return of


@pytest.mark.parametrize("most", [alignment.HOT_PAIRS, 50, 0])
def test_alignment(docs, linked, most):
    """The same whether all, some or no pairs reach the tasks as frequent ones."""
    rows = [(r["doc_id"], linked(r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
    held = collections.Counter(p for _, x in rows for p in set(x[3]))
    most_of = collections.defaultdict(int)
    for (a, _), n in held.items():
        most_of[a] = max(most_of[a], n)
    want = collections.Counter()
    for i, (a, b, groups, links) in rows:
        digest = hashlib.sha256(groups.encode()).hexdigest() if a else ""
        want[i, len(a), len(b), groups.count(";") + bool(a), len(links), sum(held[p] == most_of[p[0]] for p in links), sum(held[p] for p in links), digest] += 1
    got = alignment.report(docs, A, B, most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_alignment_of_nothing(empty):
    assert alignment.report(empty, A, B).collect() == []


def parse(text, known):
    """Phrases of a text that is read from left to right, each the longest that ``known`` holds, or one symbol."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in known:
            end += 1
        n, at = n + 1, end
    return n


def test_phrases_equal_plain_parsing():
    rng = np.random.default_rng(3)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 8)))
    known = {k: [" ".join(word(x) for _ in range(60)) for _ in range(3)] for k, x in {"x": "abcde", "y": "defgh", "z": "aeghz"}.items()}
    model = language.fit([(k, t) for k, ts in known.items() for t in ts])
    texts = ["", "q", "Abc!!", *(" ".join(word("abcdefghzqé") for _ in range(rng.integers(0, 90))) for _ in range(60))]
    fold = lambda t: " ".join(re.findall(r"[^\W\d_]+", t.lower()))
    whole = {k: "\1" + " ".join(fold(t) for t in ts) + " " for k, ts in known.items()}
    parsed = [model.symbols(t) for t in texts]
    want = [[parse(fold(t), whole[k]) for k in model.names] for t in texts]
    assert model.phrases(parsed).tolist() == want
    assert np.concatenate([model.phrases([p]) for p in parsed]).tolist() == want


def test_languages(spark, empty):
    """Held-out accuracy, nulls, texts without letters, very long and repeated rows; the label of a held-out row is never used."""
    rng = np.random.default_rng(5)
    parts = {"en": "th er ing and ou of".split(), "de": "sch ein ung der ich zu".split(), "fr": "eau que ment les oi é".split()}
    text = lambda k, n: " ".join("".join(rng.choice(parts[k], rng.integers(1, 4))) for _ in range(n))
    data = [(i, text(k, int(rng.integers(5, 60))), k) for i, k in enumerate(["en", "de", "fr"] * 80)]
    data += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !? ½", "fr"), (None, text("de", 30), "fr"), (1003, text("fr", 40_000), None), data[4], data[4], (1004, "日本語", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("own")).repartition(3)
    got = language.predictions(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(data)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240)) and rows[None]["held_out"] is False
    assert sum(rows[i]["lang_pred"] == k for i, _, k in data[:240]) >= 238
    assert [rows[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and rows[1003]["lang_pred"] == "fr" and rows[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[1004]["lang_pred"] in parts
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    other = language.predictions(df.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).repartition(5))
    assert sorted(map(tuple, other.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert language.predictions(empty).collect() == []
    assert {r["lang_pred"] for r in language.predictions(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
