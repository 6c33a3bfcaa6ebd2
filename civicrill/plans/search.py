"""The archive's search: the items of the benchmark table are the questions, the documents are the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicrill.operators.search import K1, B, facets, phrases, ranked, write_index
from civicrill.plans.registry import query
from civicrill.sources.tables import spread, table

HITS = 10
#: A question's phrase is its first words, so many.
PHRASE = 4
WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
RANKED = f"""w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents WHERE doc_id IS NOT NULL), l AS (SELECT doc_id, coalesce(len(ws), 0) AS length FROM w),
t AS (SELECT COUNT(*) AS docs, AVG(length) AS mean FROM l), p AS (SELECT doc_id, term, COUNT(*) AS n FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY 1, 2),
f AS (SELECT term, COUNT(*) AS df FROM p GROUP BY 1), a AS (SELECT DISTINCT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, doc_id, SUM(CAST(round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * {K1 + 1} / (n + {K1} * (1 - {B} + {B} * length / mean)) * 1e9) AS BIGINT)) AS w, COUNT(*) AS found
  FROM a JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id), t GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, round(w / 1e9, 6) AS score, found, row_number() OVER (PARTITION BY item_id ORDER BY round(w / 1e9, 6) DESC, doc_id) AS rank FROM s)"""


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@query(f"""WITH {RANKED} SELECT item_id, doc_id, score, found, rank FROM r WHERE rank <= {HITS}""")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each question, by rarity, frequency and length."""
    return ranked(write_index(_archive(spark, sf_dir), "doc_id"), table(spark, sf_dir, "benchmark"), "item_id", "doc_id", HITS)


@query(f"""WITH {RANKED} SELECT item_id, lang, COUNT(*) AS hits FROM r JOIN documents USING (doc_id) WHERE rank <= {HITS} GROUP BY 1, 2""")
def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each question's hits."""
    docs = _archive(spark, sf_dir)
    hits = ranked(write_index(docs, "doc_id"), table(spark, sf_dir, "benchmark"), "item_id", "doc_id", HITS)
    return facets(hits, docs, "item_id", "doc_id", "lang")


@query(f"""WITH w AS (SELECT doc_id, ' ' || array_to_string({WORDS.format('text')}, '  ') || ' ' AS t FROM documents), q AS (SELECT item_id, ' ' || array_to_string(({WORDS.format('text')})[1:{PHRASE}], '  ') || ' ' AS p FROM benchmark WHERE len({WORDS.format('text')}) > 0)
SELECT item_id, doc_id, (length(t) - length(replace(t, p, ''))) // length(p) AS times, len(string_split(trim(split_part(t, p, 1), ' '), '  ')) - CASE WHEN trim(split_part(t, p, 1), ' ') = '' THEN 1 ELSE 0 END AS first
FROM q JOIN w ON contains(t, p) WHERE item_id IS NOT NULL AND doc_id IS NOT NULL""")
def search_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the first words of a question in a row."""
    first = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", f"(?s)^[^\\p{{L}}\\p{{N}}]*(?:[\\p{{L}}\\p{{N}}]+[^\\p{{L}}\\p{{N}}]*){{1,{PHRASE}}}", 0).alias("text"))
    return phrases(write_index(_archive(spark, sf_dir), "doc_id"), first, "item_id", "doc_id")
