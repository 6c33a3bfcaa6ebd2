"""Full-text search: positional postings written in buckets of terms, scores of whole tables of questions, exact phrases, facets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicrill.operators.keyed import top_k
from civicrill.sources.shared import fresh_path, written

#: Weights of repeated terms and of a document's length: the usual constants of the ranking function.
K1, B = 1.2, 0.75
BUCKETS = 64


def terms(text: Column) -> Column:
    """Words of letters and figures, in lower case; none of a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each row folded to (term, key, length, positions); numpy over whole batches."""
    for b in batches:
        words = b.column(1)
        many = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        found = words.flatten().dictionary_encode()
        if not len(found):
            continue
        code, row = found.indices.to_numpy(), np.repeat(np.arange(len(many)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        order = np.lexsort((code, row))
        code, row = code[order], row[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])])
        positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(at[order].astype(np.int32)))
        columns = [found.dictionary.take(pa.array(code[first])), b.column(0).take(pa.array(row[first])), pa.array(many[row[first]].astype(np.int32)), positions]
        yield pa.RecordBatch.from_arrays(columns, names=["term", b.schema.names[0], "length", "positions"])


def postings(docs: DataFrame, key: str, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(term, key, length, positions from 0, bucket): where a term stands in a document, and how many terms that has. Repeated rows of a key count once.

    Words fold within their row, so what is shuffled is one row for each term of a document.
    """
    words = docs.filter(f"{key} is not null").select(key, terms(F.col(text)).alias("w"))
    kind = docs.schema[key].dataType.simpleString()
    rows = words.mapInArrow(_by_term, f"term string, {key} {kind}, length int, positions array<int>")
    # a bucket is dealt to a few tasks by term and key, so no frequent term is one task's
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("term", key), F.lit(max(1, 2 * tasks // buckets))).cast("int")
    dealt = rows.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "part": part}).repartition("bucket", "part")
    whole = dealt.groupBy("bucket", "part", "term", key, "length").agg(F.collect_list("positions").alias("p"))
    once = F.when(F.size("p") == 1, F.get("p", F.lit(0))).otherwise(F.sort_array(F.array_distinct(F.flatten("p"))))
    return whole.select("term", key, "length", once.alias("positions"), "bucket")


def write_index(docs: DataFrame, key: str, text: str = "text", buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of ``docs``, written to the shared folder; postings lie in ``buckets`` folders by hash of the term.

    lengths has one row per document, those without a term too. Writing sorts a bucket by term, so that statistics of the
    files leave out what no question asks.
    """
    spark = docs.sparkSession
    at = fresh_path(spark, "index")
    rows = postings(docs, key, text, buckets)
    rows.sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").parquet(f"{at}/postings")
    sizes = docs.filter(f"{key} is not null").select(key, F.size(terms(F.col(text))).alias("length"))
    sizes.write.parquet(f"{at}/lengths")
    return spark.read.schema(rows.schema).parquet(f"{at}/postings"), spark.read.schema(sizes.schema).parquet(f"{at}/lengths")


def ranked(index: tuple[DataFrame, DataFrame], questions: DataFrame, question: str, key: str, k: int, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(question, key, score, found, rank): the ``k`` best documents of each question; found is how many of its terms they hold.

    A term weighs by its rarity among all documents and by how often it stands in one, against the document's length; each
    term of a question counts once. Scores are rounded to six places, ties go to the smaller key. Postings that are asked for
    are shuffled once, by document; there they meet the questions, and scores fold in place before they are ranked.
    """
    found, lengths = index
    totals = lengths.agg(F.count(F.lit(1)).cast("double").alias("docs"), F.avg("length").alias("mean"))
    asked = questions.filter(f"{question} is not null").select(question, F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    asked = written(asked, "asked")
    wanted = asked.select("bucket", "term").distinct()
    rows = found.join(wanted, ["bucket", "term"], "left_semi")
    rarity = written(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "rarity")  # a file's size is known before the join
    n = F.size("positions").cast("double")
    weighed = rows.select("term", key, n.alias("n"), "length").join(rarity, "term").crossJoin(F.broadcast(totals))  # totals is one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # whole numbers, so that no order of adding shows
    held = weighed.select("term", key, F.round(weight * 1e9).cast("long").alias("w")).repartition(key)
    scores = held.join(asked.select(question, "term"), "term").groupBy(question, key)
    scores = scores.agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("found")).withColumn("score", F.round(F.col("w") / 1e9, 6))
    return top_k(scores, [question], k, F.desc("score"), F.col(key)).select(question, key, "score", "found", "rank")


def phrases(index: tuple[DataFrame, DataFrame], questions: DataFrame, question: str, key: str, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(question, key, times, first): documents in which all terms of a question stand in a row, how often, and from which term on.

    Each term's positions less its place in the phrase must all hold the same start. Postings that are asked for are shuffled
    once, by document; there the places of a phrase meet, so no position is a row of its own. Repeated terms of a phrase are
    looked up once for each place.
    """
    found, _ = index
    asked = questions.filter(f"{question} is not null").select(question, terms(F.col(text)).alias("w")).filter(F.size("w") > 0)
    each = asked.select(question, F.size("w").alias("many"), F.posexplode("w").alias("place", "term")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    each = written(each, "asked")
    rows = found.join(each.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").select("term", key, "length", "positions").repartition(key)
    starts = F.filter(F.transform("positions", lambda x: x - F.col("place")), lambda x: x >= 0)
    met = rows.join(each.drop("bucket"), "term").select(question, key, "length", "many", starts.alias("starts"))
    whole = met.groupBy(question, key, "length", "many").agg(F.collect_list("starts").alias("s")).filter(F.size("s") == F.col("many"))
    common = F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", F.lit(0)), F.array_intersect)
    return whole.select(question, key, common.alias("s")).filter(F.size("s") > 0).groupBy(question, key).agg(F.sum(F.size("s")).alias("times"), F.min(F.array_min("s")).alias("first"))


def facets(hits: DataFrame, docs: DataFrame, question: str, key: str, facet: str) -> DataFrame:
    """(question, facet, hits): how many of a question's documents have each value, most first within a question by rank."""
    return hits.join(docs.select(key, facet), key).groupBy(question, facet).agg(F.count(F.lit(1)).alias("hits"))
