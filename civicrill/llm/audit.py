"""Interaction audit of filters: what each filter removes, for every order in which they may be applied.

Each document's failures are bits of a mask. Documents fold to cells (part, mask) with their counts; the cells are
unpivoted against the steps of all orders, and running bit-or windows tell which failures an earlier step has met.
After the fold no work grows with the number of documents.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicrill.llm.common import cut

FILTERS = "ABCDE"
#: A: fewest words. B, C: percentages of distinct words and of capitals. D: symbols.
WORDS, DISTINCT, CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"
BLANK = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure of each filter that looks at a text alone, which is not null. A text without words fails A and not B."""
    words = F.array_remove(F.split(text, BLANK), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT,
        "C": capitals * 100 > F.length(text) * CAPITALS,
        "D": text.rlike(SYMBOLS),
    }


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit i for letter i of FILTERS) of every row.

    Null texts are empty, null sources the empty string. E is identity of the text with that of any smaller doc_id, all rows
    counted; a null id is smaller than none and has no smaller one. Rows of one id and text are no copies of each other.
    """
    text, bits = F.coalesce(F.col("text"), F.lit("")), {x: 1 << i for i, x in enumerate(FILTERS)}
    alone = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("__text"))
    own = reduce(lambda a, b: a + b, [F.when(c, bits[x]).otherwise(0) for x, c in text_failures(F.col("__text")).items()])
    base = cut(alone.select("doc_id", "part", own.alias("mask"), F.unhex(F.sha2("__text", 256)).alias("digest")), "masks")
    known = base.filter("doc_id is not null")
    # copies fold before they shuffle; a row of a large group of copies meets only the first of its own id
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = known.join(first, ["doc_id", "digest"], "left")
    later = F.col("mask") + F.when(F.col("first").isNull(), bits["E"]).otherwise(0)
    return marked.select("doc_id", "part", later.alias("mask")).unionByName(base.filter("doc_id is null").select("doc_id", "part", "mask"))


def cells(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each cell. A document is good or toxic if any label row of its id says so."""
    says = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(f"is_{c}") for c in ("quality", "toxic")]
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(*says).filter("is_quality or is_toxic")
    known = marked.filter("doc_id is not null").join(said, "doc_id", "left").drop("doc_id")
    unknown = marked.filter("doc_id is null").drop("doc_id").withColumns({"is_quality": F.lit(False), "is_toxic": F.lit(False)})
    of = lambda c: F.count(F.when(F.col(c), 1))
    return known.unionByName(unknown).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), of("is_quality").alias("good"), of("is_toxic").alias("toxic"))


def steps(spark, filters: str = FILTERS) -> DataFrame:
    """filter_order, step (from 1), filter and bit, of every order of the filters."""
    rows = [("".join(o), i + 1, f, 1 << filters.index(f)) for o in permutations(filters) for i, f in enumerate(o)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, bit int")


def interactions(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, filter_order and step of ``found`` (part, mask, n, good, toxic), zeros included.

    kept: documents left after the step; removed: by it; redundant: failing its filter, removed earlier; unique_fails:
    failing its filter only; good_lost and toxic_lost: removed by it; shapley: removed by its filter in all orders together.
    """
    each = found.join(F.broadcast(steps(found.sparkSession, filters)))  # a row of each step for each cell
    each = each.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("earlier", F.coalesce(F.bit_or("fails").over(earlier), F.lit(0)))
    fails, before = F.col("fails") != 0, F.col("earlier") != 0
    total = lambda when, of="n": F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0))
    metrics = each.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~before).alias("kept"),
        total(fails & ~before).alias("removed"),
        total(fails & before).alias("redundant"),
        total(fails & (F.col("mask") == F.col("bit"))).alias("unique_fails"),
        total(fails & ~before, "good").alias("good_lost"),
        total(fails & ~before, "toxic").alias("toxic_lost"),
    )
    return metrics.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over all documents, by source."""
    return interactions(cells(masks(docs), labels))


#: The same in SQL.
SQL = r"""WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base),
masks AS (
  SELECT doc_id, part,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > MIN(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM words),
said AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, COUNT(*) AS n, COUNT(*) FILTER (WHERE good) AS good, COUNT(*) FILTER (WHERE toxic) AS toxic
  FROM masks LEFT JOIN said USING (doc_id) GROUP BY 1, 2),
letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders5 AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT filter_order, step, f, bit, (SELECT coalesce(SUM(bit), 0) FROM letters l WHERE position(l.f IN filter_order) < step)::INT AS past
  FROM orders5, range(1, 6) r(step), letters WHERE f = filter_order[step]),
metrics AS (
  SELECT part, filter_order, step, f,
    SUM(CASE WHEN mask & (past + bit) = 0 THEN n ELSE 0 END) AS kept,
    SUM(CASE WHEN mask & bit <> 0 AND mask & past = 0 THEN n ELSE 0 END) AS removed,
    SUM(CASE WHEN mask & bit <> 0 AND mask & past <> 0 THEN n ELSE 0 END) AS redundant,
    SUM(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    SUM(CASE WHEN mask & bit <> 0 AND mask & past = 0 THEN good ELSE 0 END) AS good_lost,
    SUM(CASE WHEN mask & bit <> 0 AND mask & past = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM metrics"""
