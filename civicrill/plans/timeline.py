"""What happened when: one event schema over many sources, weekly issues, transcripts, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicrill.functions import text as T
from civicrill.functions.dates import seconds
from civicrill.functions.numbers import exact
from civicrill.operators.transcripts import blocks, carried, without_repeats
from civicrill.plans.registry import query
from civicrill.plans.standins import CONTRACTS, contracts
from civicrill.sources.tables import table
from civicrill.streaming.recent import AGE, KEEP, drained, recent_changes
from civicrill.streaming.weekly import events

EVENTS = f"""{CONTRACTS}, timeline AS (
  SELECT 'contract-' || id AS id, CAST(signed AS DATE) AS day, 'day' AS precision, 'contract' AS kind, CAST(amount AS DOUBLE) AS amount, CASE direction WHEN 'undetermined' THEN 'disputed' ELSE 'fact' END AS certainty, day IS NULL AS suspicious FROM contracts
  UNION ALL SELECT 'event-' || event_id, CAST(ts AS DATE), 'day', event_type, CAST(value AS DOUBLE), 'fact', false FROM events
  UNION ALL SELECT 'document-' || doc_id, CAST(make_date(CAST(2000 + doc_id % 20 AS INTEGER), 1, 1) AS DATE), 'year', 'document', NULL, CASE WHEN source = 'src1' THEN 'estimate' ELSE 'fact' END, false FROM documents)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three sources in one schema; what a source lacks is null."""
    c = contracts(spark, sf_dir).select(
        F.concat(F.lit("contract-"), "id").alias("id"), F.col("signed").alias("day"), F.lit("day").alias("precision"), F.lit("contract").alias("kind"), F.col("amount").cast("double").alias("amount"), F.when(F.col("direction") == "undetermined", "disputed").otherwise("fact").alias("certainty"), F.col("day").isNull().alias("suspicious")
    )
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("event-"), "event_id").alias("id"), F.to_date("ts").alias("day"), F.lit("day").alias("precision"), F.col("event_type").alias("kind"), F.col("value").alias("amount"), F.lit("fact").alias("certainty"), F.lit(False).alias("suspicious"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("document-"), "doc_id").alias("id"), F.make_date((2000 + F.col("doc_id") % 20).cast("int"), F.lit(1), F.lit(1)).alias("day"), F.lit("year").alias("precision"), F.lit("document").alias("kind"), F.lit(None).cast("double").alias("amount"), F.when(F.col("source") == "src1", "estimate").otherwise("fact").alias("certainty"), F.lit(False).alias("suspicious"))
    return c.unionByName(e).unionByName(d)


@query(f"WITH {EVENTS} SELECT id, CAST(day AS VARCHAR) AS day, precision, kind, amount, certainty, suspicious FROM timeline")
def event_union_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST01, PJ03: the union of the sources."""
    return timeline(spark, sf_dir).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {EVENTS} SELECT kind, certainty, COUNT(*) AS n, CAST(MIN(day) FILTER (WHERE NOT suspicious) AS VARCHAR) AS first, CAST(MAX(day) FILTER (WHERE NOT suspicious) AS VARCHAR) AS last, COUNT(*) FILTER (WHERE suspicious) AS suspicious, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM timeline GROUP BY 1, 2""")
def timeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG28: facts and estimates counted apart; the range leaves suspicious days out."""
    good = F.when(~F.col("suspicious"), F.col("day"))
    return timeline(spark, sf_dir).groupBy("kind", "certainty").agg(F.count(F.lit(1)).alias("n"), F.min(good).cast("string").alias("first"), F.max(good).cast("string").alias("last"), F.count_if(F.col("suspicious")).alias("suspicious"), F.sum(exact(F.col("amount"))).cast("double").alias("amount"))


@query("""WITH r AS (SELECT CAST(MIN(ts) AS DATE) AS a, CAST(MAX(ts) AS DATE) AS b FROM events WHERE event_type IS NOT NULL), p AS (SELECT CAST(unnest(generate_series(a + 7, b, INTERVAL 7 DAY)) AS DATE) AS stop FROM r) SELECT CAST(stop - 7 AS VARCHAR) AS start, CAST(stop AS VARCHAR) AS stop, event_type AS section, COUNT(event_id) AS items, CASE WHEN COUNT(event_id) = 0 THEN 'empty' ELSE 'ok' END AS state
FROM p CROSS JOIN (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL) k LEFT JOIN (SELECT event_id, event_type AS et, CAST(ts AS DATE) AS d FROM events WHERE event_type <> 'error' OR day(ts) > 9) e ON et = event_type AND d BETWEEN stop - 7 AND stop GROUP BY 1, 2, 3""")
def weekly_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT09, FL01: issues of eight days, both ends included, so neighbours share a day, from the first event on; empty sections stay.

    The number of a day's issues follows from its distance to the first day, so each day is dealt to its at most two issues.
    """
    e = table(spark, sf_dir, "events").filter("event_type is not null").select("event_type", F.to_date("ts").alias("d"))
    # one row
    ends = e.agg(F.min("d").alias("first"), F.max("d").alias("last"))
    issues = F.floor(F.datediff("last", "first") / 7)
    kept = e.filter((F.col("event_type") != "error") | (F.dayofmonth("d") > 9)).crossJoin(F.broadcast(ends)).withColumn("at", F.datediff("d", "first"))
    own = F.floor(F.col("at") / 7) + 1
    both = F.filter(F.array(own, F.when(F.col("at") % 7 == 0, own - 1)), lambda i: i.between(1, issues))
    n = kept.select("event_type", F.explode(both).alias("issue")).groupBy("event_type", "issue").agg(F.count(F.lit(1)).alias("n"))
    axis = e.select("event_type").distinct().crossJoin(F.broadcast(ends.filter(issues >= 1).select("first", F.explode(F.sequence(F.lit(1).cast("long"), issues)).alias("issue"))))
    items, stop = F.coalesce("n", F.lit(0).cast("long")), F.date_add("first", (F.col("issue") * 7).cast("int"))
    rows = axis.join(n, ["event_type", "issue"], "left")
    return rows.select(F.date_sub(stop, 7).cast("string").alias("start"), stop.cast("string").alias("stop"), F.col("event_type").alias("section"), items.alias("items"), F.when(items == 0, "empty").otherwise("ok").alias("state"))


@query("""WITH t AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'speaker ' || CAST(turn AS VARCHAR) END AS heading FROM conversations) SELECT conv_id, turn, last_value(heading IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS speaker FROM t""")
def heading_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN03, SC15: the last heading holds until the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.concat(F.lit("speaker "), F.col("turn").cast("string"))).alias("heading"))
    return carried(c, ["conv_id"], "turn", "heading", "speaker").select("conv_id", "turn", "speaker")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'b' ELSE 'a' END AS speaker, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, i, speaker, CAST(n AS BIGINT) AS size, CAST(1 AS BIGINT) AS block FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.i, t.speaker, CASE WHEN t.speaker = r.speaker AND r.size < 400 THEN r.size + t.n ELSE t.n END, CASE WHEN t.speaker = r.speaker AND r.size < 400 THEN r.block ELSE r.block + 1 END FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
SELECT conv_id, block, MIN(speaker) AS speaker, COUNT(*) AS segments, MAX(size) AS size FROM r GROUP BY 1, 2""")
def transcript_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN04: segments of one speaker run together until the block has 400 characters."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "b").otherwise("a").alias("speaker"), F.length("text").cast("long").alias("n"))
    return blocks(c, "conv_id", "turn", "speaker", "n", 400)


@query("SELECT conv_id, turn AS start, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn + 5) AS stop FROM conversations")
def next_start_as_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN05: a segment ends where the next begins, the last after five seconds."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("start"), F.coalesce(F.lead("turn").over(w), F.col("turn") + 5).alias("stop"))


#: Segments of which some only repeat the end of the one before.
SEGMENT = "CASE turn % 3 WHEN 0 THEN turn || ' said and tail' WHEN 1 THEN 'tail' ELSE CASE WHEN conv_id % 2 = 0 THEN 'and tail' ELSE 'more' END END"


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {SEGMENT} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), r AS (SELECT conv_id, i, turn, text, text AS last, true AS kept FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.i, t.turn, t.text, CASE WHEN ends_with(r.last, t.text) THEN r.last ELSE t.text END, NOT ends_with(r.last, t.text) FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
SELECT conv_id, turn, text FROM r WHERE kept""")
def suffix_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN06: a segment that only repeats the end of the last kept one goes."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(SEGMENT).alias("text"))
    return without_repeats(df, "conv_id", "turn", "text").select("conv_id", "turn", "text")


#: Time codes in three forms, one with a fraction.
CODE = "CASE conv_id % 4 WHEN 0 THEN concat('0', turn, ':', 10 + conv_id % 50, ':0', conv_id % 10) WHEN 1 THEN concat(turn, ':', 10 + conv_id % 50, ':', 10 + turn, '.5') WHEN 2 THEN concat(conv_id % 60, ':', 10 + turn) ELSE concat('', conv_id) END"


@query(f"""WITH t AS (SELECT conv_id, turn, list_reverse(string_split({CODE}, ':')) AS p FROM conversations) SELECT conv_id, turn, coalesce(CAST(p[1] AS DOUBLE), 0) + 60 * coalesce(CAST(p[2] AS DOUBLE), 0) + 3600 * coalesce(CAST(p[3] AS DOUBLE), 0) AS seconds FROM t""")
def time_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT06: time codes as seconds."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", seconds(F.expr(CODE)).alias("seconds"))


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages), s AS (SELECT page_id, regexp_replace(split_part(b, '?', 1), '/+$', '') AS path, list_sort(list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS q FROM u)
SELECT page_id, lower(regexp_extract(path, '^[a-zA-Z]+://[^/]*')) || regexp_replace(path, '^[a-zA-Z]+://[^/]*', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM s""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX18: addresses without tracking parameters, fragment and trailing slash."""
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


PAGE_TEXT = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gis'), '<br[^>]*>|</(?:p|div|li|h[1-6]|tr|title)>', chr(10), 'gi'), '<[^>]*>', ' ', 'g'), '[ \\t]+', ' ', 'g'), '', '')"""


@query(f"""WITH t AS (SELECT page_id, replace(replace(replace(replace(replace(replace({PAGE_TEXT}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, ' ?' || chr(10) || ' ?', chr(10), 'g'), chr(10) || '{{2,}}', chr(10), 'g'))) AS text_md5 FROM t""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX17: text of a page."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("text_md5"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS heading, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages""")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ16, SC16: language, title, heading and links of a page; what is missing is null."""
    first = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", first('<html lang="([a-z]+)"').alias("lang"), F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("")).alias("title"), first("<h1>([^<]*)</h1>").alias("heading"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


@query("""WITH i AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS items FROM pages) SELECT page_id, CAST(p AS BIGINT) AS pos, items[p] AS target FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS p FROM i)""")
def register_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC15, SC21: repeated blocks of a page as rows with their place."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("p", "target")).select("page_id", (F.col("p") + 1).cast("long").alias("pos"), "target")


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://([^/]*).*$', '\\1') AS host, CAST(len(regexp_extract_all(html, '<[a-zA-Z]')) AS BIGINT) AS tags FROM pages) SELECT host, COUNT(*) AS pages, MAX(tags) AS most, CASE WHEN MAX(tags) > 45000 THEN 'error' WHEN MAX(tags) > 60 THEN 'warning' ELSE 'ok' END AS verdict FROM p GROUP BY 1""")
def dom_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ12: tags of the largest page of each host against a budget."""
    p = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://([^/]*).*$", "$1").alias("host"), F.regexp_count("html", F.lit("<[a-zA-Z]")).cast("long").alias("tags"))
    most = F.max("tags")
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), most.alias("most"), F.when(most > 45000, "error").when(most > 60, "warning").otherwise("ok").alias("verdict"))


@query("""WITH k AS (SELECT regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '') AS k, page_id FROM pages), a AS (SELECT DISTINCT k FROM k WHERE page_id % 3 < 2), b AS (SELECT DISTINCT k FROM k WHERE page_id % 3 > 0) SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'first only' WHEN a.k IS NULL THEN 'second only' ELSE 'both' END AS found FROM a FULL JOIN b ON a.k = b.k""")
def two_list_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG19: two listings of the same documents compared both ways."""
    k = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[#?].*$", ""), "/+$", "").alias("key"))
    a, b = k.filter("page_id % 3 < 2").select("key").distinct().withColumn("a", F.lit(1)), k.filter("page_id % 3 > 0").select("key").distinct().withColumn("b", F.lit(1))
    return a.join(b, "key", "full_outer").select("key", F.when(F.col("b").isNull(), "first only").when(F.col("a").isNull(), "second only").otherwise("both").alias("found"))


@query("""WITH o AS (SELECT p_brand AS id, p_type AS kind, p_size AS size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n = 1), n AS (SELECT p_brand AS id, p_type AS kind, CASE WHEN p_size % 2 = 0 THEN p_size END AS size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1 AND p_brand <> 'Brand#3')
SELECT coalesce(o.id, n.id) AS id, coalesce(o.kind, n.kind) AS kind, CAST(coalesce(n.size, o.size) AS BIGINT) AS size, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'new' ELSE 'merged' END AS origin FROM o FULL JOIN n ON o.id = n.id""")
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN29, PG10: an upsert that keeps fields set by hand, fills blanks and keeps rows of earlier runs."""
    p = table(spark, sf_dir, "part")
    old = p.groupBy(F.col("p_brand").alias("id")).agg(F.min_by("p_type", "p_partkey").alias("old_kind"), F.min_by("p_size", "p_partkey").alias("old_size"))
    new = p.groupBy(F.col("p_brand").alias("id")).agg(F.max_by("p_type", "p_partkey").alias("new_kind"), F.max_by("p_size", "p_partkey").alias("s")).filter("id <> 'Brand#3'").withColumn("new_size", F.when(F.col("s") % 2 == 0, F.col("s")))
    origin = F.when(F.col("new_kind").isNull(), "kept").when(F.col("old_kind").isNull(), "new").otherwise("merged")
    return old.join(new, "id", "full_outer").select("id", F.coalesce("old_kind", "new_kind").alias("kind"), F.coalesce("new_size", "old_size").cast("long").alias("size"), origin.alias("origin"))


@query("""WITH e AS (SELECT user_id AS person, event_type AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events) SELECT person, COUNT(v) AS known, MIN(v) AS least, MAX(v) AS most, COUNT(*) FILTER (WHERE v > 50) AS large FROM e GROUP BY 1""")
def tolerant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ14, PJ19: fields read on demand from loosely typed records; what is absent or unreadable is null."""
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("person"), v.alias("v")).groupBy("person").agg(F.count("v").alias("known"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(F.col("v") > 50).alias("large"))


@query(f"""WITH o AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
  FROM (SELECT DISTINCT ON (user_id, ts, event_id) * FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL AND event_type IS NOT NULL)),
c AS (SELECT * FROM o WHERE before IS NOT NULL AND before <> event_type),
k AS (SELECT *, list_filter(list(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {KEEP - 1} PRECEDING AND CURRENT ROW), lambda t: t > ts - INTERVAL {AGE.days} DAY) AS times FROM c)
SELECT user_id, event_id, epoch_us(ts) AS ts, before, event_type AS after, len(times) AS kept, epoch_us(times[1]) AS oldest FROM k""")
def recent_changes_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each user's events out of a stream with bounded state, drained; the same rows as a window over the table."""
    rows = drained(recent_changes(events(spark, sf_dir)), spark)
    return rows.withColumns({c: F.unix_micros(c) for c in ("ts", "oldest")})
