"""Planning processes, registers, budgets in several layouts, newsletters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicrill.functions.numbers import exact, total
from civicrill.operators.keyed import first_by, top_k
from civicrill.plans.registry import query
from civicrill.plans.standins import AS_OF, CONTRACTS, contracts
from civicrill.sources.tables import table


def _s(c: Column) -> Column:
    return c.cast("string")


@query("""WITH d AS (SELECT o_orderkey % 400 AS change, MIN(CAST(o_orderdate AS DATE)) AS day, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), r AS (SELECT l_partkey % 450 + 50 AS change, MIN(CAST(l_shipdate AS DATE)) AS day, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(d.change, r.change) AS change, d.n AS documents, r.n AS resolutions, CAST(least(d.day, r.day) AS VARCHAR) AS earliest FROM d FULL JOIN r ON d.change = r.change""")
def planning_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG35: changes of the plan out of documents and resolutions, the earliest date of either."""
    d = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy((F.col("o_orderkey") % 400).alias("change")).agg(F.min(F.to_date("o_orderdate")).alias("a"), F.count(F.lit(1)).alias("documents"))
    r = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy((F.col("l_partkey") % 450 + 50).alias("change")).agg(F.min(F.to_date("l_shipdate")).alias("b"), F.count(F.lit(1)).alias("resolutions"))
    return d.join(r, "change", "full_outer").select("change", "documents", "resolutions", _s(F.least("a", "b")).alias("earliest"))


@query(f"""WITH s AS (SELECT o_custkey % 50 AS process, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'adoption' WHEN 'O' THEN 'draft' ELSE 'legal' END AS stage, 'plan' AS source FROM orders UNION ALL SELECT l_suppkey % 50, CAST(l_shipdate AS DATE), CASE l_returnflag WHEN 'R' THEN 'hearing' WHEN 'A' THEN 'draft' ELSE 'legal' END, 'documents' FROM lineitem UNION ALL SELECT user_id % 50, CAST(ts AS DATE), 'hearing', 'web' FROM events),
k AS (SELECT process, day, stage, COUNT(*) AS mentions, COUNT(DISTINCT source) AS sources FROM s GROUP BY 1, 2, 3)
SELECT process, COUNT(*) AS steps, CAST(SUM(mentions) AS BIGINT) AS mentions, COUNT(*) FILTER (WHERE sources > 1) AS confirmed, COUNT(*) FILTER (WHERE stage = 'hearing') AS hearings, arg_max(stage, (day, stage)) FILTER (WHERE day <= DATE '{AS_OF}' AND stage <> 'legal') AS current_stage FROM k GROUP BY 1""")
def process_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG18: steps of a process out of three sources; the same step on one day counts once, with its mentions. The current stage is that of the last past step; dates set by law do not count."""
    o, li, e = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    status = F.when(F.col("o_orderstatus") == "F", "adoption").when(F.col("o_orderstatus") == "O", "draft").otherwise("legal")
    flag = F.when(F.col("l_returnflag") == "R", "hearing").when(F.col("l_returnflag") == "A", "draft").otherwise("legal")
    s = (
        o.select((F.col("o_custkey") % 50).alias("process"), F.to_date("o_orderdate").alias("day"), status.alias("stage"), F.lit("plan").alias("source"))
        .unionByName(li.select((F.col("l_suppkey") % 50).alias("process"), F.to_date("l_shipdate").alias("day"), flag.alias("stage"), F.lit("documents").alias("source")))
        .unionByName(e.select((F.col("user_id") % 50).alias("process"), F.to_date("ts").alias("day"), F.lit("hearing").alias("stage"), F.lit("web").alias("source")))
    )
    k = s.groupBy("process", "day", "stage").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("source").alias("sources"))
    past = (F.col("day") <= F.lit(AS_OF).cast("date")) & (F.col("stage") != "legal")
    return k.groupBy("process").agg(F.count(F.lit(1)).alias("steps"), F.sum("mentions").alias("mentions"), F.count_if(F.col("sources") > 1).alias("confirmed"), F.count_if(F.col("stage") == "hearing").alias("hearings"), F.max(F.when(past, F.struct("day", "stage"))).alias("now")).select("process", "steps", "mentions", "confirmed", "hearings", F.col("now.stage").alias("current_stage"))


STEPS = """t AS (SELECT l_orderkey AS id, 'Pořízení: ' || string_agg(strftime(l_shipdate, '%d.%m.%Y') || ' krok ' || l_returnflag || ' bod ' || l_linenumber, '; ' ORDER BY l_shipdate, l_returnflag, l_linenumber) AS text FROM lineitem GROUP BY 1)"""


@query(f"""WITH {STEPS}, x AS (SELECT id, regexp_extract_all(text, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}') AS days, regexp_split_to_array(text, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}') AS said FROM t), i AS (SELECT *, unnest(range(1, len(days) + 1)) AS k FROM x)
SELECT id, k AS step, CAST(strptime(days[k], '%d.%m.%Y')::DATE AS VARCHAR) AS day, trim(regexp_replace(said[k + 1], '[;\\s]+$', '')) AS said FROM i""")
def date_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX31: each date of a text starts a step, whose description runs to the next date."""
    one = F.struct("l_shipdate", "l_returnflag", "l_linenumber")
    listed = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.concat(F.date_format(x["l_shipdate"], "dd.MM.yyyy"), F.lit(" krok "), x["l_returnflag"], F.lit(" bod "), x["l_linenumber"].cast("string")))
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("Pořízení: "), F.array_join(listed, "; ")).alias("text"))
    date = "[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}"
    steps = F.arrays_zip(F.regexp_extract_all("text", F.lit(date), F.lit(0)).alias("day"), F.slice(F.split("text", date), 2, 10_000_000).alias("said"))
    return t.select("id", F.posexplode(steps).alias("p", "x")).select("id", (F.col("p") + 1).cast("long").alias("step"), _s(F.to_date("x.day", "dd.MM.yyyy")).alias("day"), F.trim(F.regexp_replace("x.said", "[;\\s]+$", "")).alias("said"))


@query("""WITH a AS (SELECT c_custkey AS id, c_custkey % 30 AS code, c_mktsegment AS street FROM customer) SELECT a.code, n_name AS precinct, COUNT(*) AS addresses, COUNT(DISTINCT street) AS streets, n_name IS NULL AS unknown FROM a LEFT JOIN nation ON n_nationkey = code GROUP BY 1, 2""")
def address_precincts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN25: addresses by the code of their precinct; codes that no precinct has are reported. Addresses fold by code before they meet the precincts."""
    a = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 30).alias("code")).agg(F.count(F.lit(1)).alias("addresses"), F.countDistinct("c_mktsegment").alias("streets"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("precinct"))
    return a.join(n, "code", "left").withColumn("unknown", F.col("precinct").isNull())


@query(f"""WITH {CONTRACTS} SELECT owner, COUNT(*) AS contracts, COUNT(*) FILTER (WHERE day IS NULL) AS discarded, CAST(MIN(day) AS VARCHAR) AS first, CAST(MAX(day) AS VARCHAR) AS last FROM contracts GROUP BY 1""")
def reasonable_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL02: a date of an impossible year is unknown; its row stays and the number of such dates is published."""
    return contracts(spark, sf_dir).groupBy("owner").agg(F.count(F.lit(1)).alias("contracts"), F.count_if(F.col("day").isNull()).alias("discarded"), _s(F.min("day")).alias("first"), _s(F.max("day")).alias("last"))


@query("""SELECT source, COUNT(*) AS items, COUNT(*) FILTER (WHERE regexp_matches(text, '^[^\\n]*\\|[^\\n]*\\|')) AS agendas, COUNT(*) FILTER (WHERE NOT regexp_matches(text, '^[^\\n]*\\|[^\\n]*\\|')) AS matched FROM documents GROUP BY 1""")
def agenda_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL06: points that only list the agenda take no part in matching and are counted."""
    agenda = F.col("text").rlike("^[^\\n]*\\|[^\\n]*\\|")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count_if(agenda).alias("agendas"), F.count_if(~agenda).alias("matched"))


@query("""WITH r AS (SELECT user_id AS person, list_sort(list_distinct(list(event_type))) AS roles FROM events WHERE value > 100 GROUP BY 1) SELECT person, array_to_string(roles, ',') AS roles FROM r WHERE list_has_any(roles, ['purchase', 'signup'])""")
def public_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL09: persons with at least one public role."""
    r = table(spark, sf_dir, "events").filter("value > 100").groupBy(F.col("user_id").alias("person")).agg(F.sort_array(F.collect_set("event_type")).alias("roles"))
    return r.filter(F.arrays_overlap("roles", F.array(F.lit("purchase"), F.lit("signup")))).select("person", F.array_join("roles", ",").alias("roles"))


FORBIDDEN = ("birth", "home", "k")


@query("""WITH k AS (SELECT event_type, unnest(json_keys(props)) AS key FROM events) SELECT event_type, key, COUNT(*) AS found, key IN ('birth', 'home', 'k') AS forbidden FROM k GROUP BY 1, 2""")
def personal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL11: keys of records against the list of those that may not be published."""
    k = table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return k.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("found")).withColumn("forbidden", F.col("key").isin(*FORBIDDEN))


@query("""WITH s AS (SELECT l_suppkey AS page, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) % 3 AS b FROM lineitem), r AS (SELECT page, a, MAX(b) OVER (PARTITION BY page ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), g AS (SELECT page, reach, a - reach AS gap FROM r WHERE a > reach)
SELECT page, MAX(gap) AS gap, CAST(arg_max(reach, (gap, -(reach - DATE '1990-01-01'))) AS VARCHAR) AS after, COUNT(*) AS gaps FROM g GROUP BY 1""")
def largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN08: the largest free stretch between intervals in one dimension, the first of equal ones, where a page is cut."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.to_date("l_shipdate").alias("a"), F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int") % 3).alias("b"))
    reach = F.max("b").over(Window.partitionBy("page").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    g = li.withColumn("reach", reach).filter("a > reach").withColumn("gap", F.datediff("a", "reach").cast("long"))
    return g.groupBy("page").agg(F.max("gap").alias("gap"), _s(F.max_by("reach", F.struct("gap", -F.datediff("reach", F.lit("1990-01-01").cast("date"))))).alias("after"), F.count(F.lit(1)).alias("gaps"))


#: A heading has at most so many words, and at most this part of the length of a middling line.
HEADING_WORDS, HEADING_PART, LEAST_ARTICLE, LEAD = 26, 0.5, 260, 160
ARTICLES = f"""l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), b AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM l), f AS (SELECT * FROM b WHERE trim(line, ' ') <> ''),
m AS (SELECT doc_id, quantile_disc(length(line), 0.5) AS middling FROM f GROUP BY 1), h AS (SELECT doc_id, pos, line, length(line) <= {HEADING_PART} * middling AND len(string_split(line, ' ')) <= {HEADING_WORDS} AS heading FROM f JOIN m USING (doc_id)),
n AS (SELECT *, SUM(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS article FROM h),
j AS (SELECT doc_id, CAST(article AS BIGINT) AS article, MIN(line) FILTER (WHERE heading) AS heading, string_agg(CASE WHEN line LIKE '%-' THEN rtrim(line, '-') ELSE line || ' ' END, '' ORDER BY pos) FILTER (WHERE NOT heading) AS body FROM n GROUP BY 1, 2)"""


#: Characters that no text uses, around headings.
OPENS, CLOSES = "\ufdd0", "\ufdd1"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ls (pos, line of the lines that are not blank) and middling, the middling length of these lines; all within its row."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("pos"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")
    d = table(spark, sf_dir, "documents").select("doc_id", lines.alias("ls"))
    lengths = F.sort_array(F.transform("ls", lambda x: F.length(x["line"])))
    middling = F.get("lengths", F.greatest(F.lit(0), F.ceil(F.size("lengths") * F.lit(0.5)).cast("int") - 1))
    return d.withColumn("lengths", lengths).withColumn("middling", middling)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line and whether the line is a heading, by the middling length of the document's lines."""
    each = _lines(spark, sf_dir).select("doc_id", "middling", F.explode("ls").alias("x"))
    heading = (F.length("x.line") <= F.col("middling") * HEADING_PART) & (F.size(F.split("x.line", " ")) <= HEADING_WORDS)
    return each.select("doc_id", "x.pos", "x.line", heading.alias("heading"))


@query(f"""WITH {ARTICLES} SELECT doc_id, COUNT(*) AS blocks, COUNT(*) FILTER (WHERE heading) AS headings, MIN(line) FILTER (WHERE heading) AS least FROM h GROUP BY 1""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX27: headings of a page by their size against the middling block."""
    return _blocks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("heading").alias("headings"), F.min(F.when(F.col("heading"), F.col("line"))).alias("least"))


@query(f"""WITH {ARTICLES} SELECT doc_id, article, heading, length(body) AS chars, md5(body) AS body, regexp_extract(body, '(?s)^(.{{0,{LEAD}}}?[.!?])(?:\\s|$)', 1) AS lead FROM j WHERE length(body) >= {LEAST_ARTICLE}""")
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX28: a heading opens an article, the blocks below it are its body, hyphens at line ends joined; short ones go. The lead is the first sentence, if it is short.

    All of a document is worked out in its row: lines are joined with marks before headings and after them, and cut there again.
    """
    heading = lambda x: (F.length(x) <= F.col("middling") * HEADING_PART) & (F.size(F.split(x, " ")) <= HEADING_WORDS)
    body = lambda x: F.when(x.endswith("-"), F.regexp_replace(x, "-+$", "")).otherwise(F.concat(x, F.lit(" ")))
    marked = F.transform("ls", lambda x: F.when(heading(x["line"]), F.concat(F.lit(OPENS), x["line"], F.lit(CLOSES))).otherwise(body(x["line"])))
    parts = F.split(F.array_join(marked, ""), OPENS)
    a = _lines(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("article", "part"))
    after = F.when(F.col("article") == 0, F.col("part")).otherwise(F.substring_index("part", CLOSES, -1))
    a = a.select("doc_id", F.col("article").cast("long").alias("article"), F.when(F.col("article") > 0, F.substring_index("part", CLOSES, 1)).alias("heading"), after.alias("b")).filter(F.length("b") >= LEAST_ARTICLE)
    return a.select("doc_id", "article", "heading", F.length("b").cast("long").alias("chars"), F.md5("b").alias("body"), F.regexp_extract("b", f"(?s)^(.{{0,{LEAD}}}?[.!?])(?:\\s|$)", 1).alias("lead"))


@query("""WITH t AS (SELECT doc_id, source, CASE WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '|') THEN 'table' ELSE 'other' END AS old, CASE WHEN contains(text, 'Licensed under') THEN 'licence' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '|') THEN 'table' ELSE 'other' END AS new FROM documents)
SELECT new AS tag, COUNT(*) AS tagged, COUNT(*) FILTER (WHERE old <> new) AS changed, COUNT(DISTINCT source) FILTER (WHERE old <> new) AS rewritten, COUNT(*) / (SELECT COUNT(*) FROM t) AS share FROM t GROUP BY 1""")
def retagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG06: tags worked out anew over the archive: how many changed, how many files that rewrites, and the share of each tag."""
    t, text = table(spark, sf_dir, "documents"), F.col("text")
    old = F.when(text.contains("@"), "contact").when(text.contains("|"), "table").otherwise("other")
    new = F.when(text.contains("Licensed under"), "licence").otherwise(old)
    g = t.select("source", old.alias("old"), new.alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("tagged"), F.count_if(F.col("old") != F.col("tag")).alias("changed"), F.countDistinct(F.when(F.col("old") != F.col("tag"), F.col("source"))).alias("rewritten"))
    return g.crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("all")))).select("tag", "tagged", "changed", "rewritten", (F.col("tagged") / F.col("all")).alias("share"))


@query("""WITH t AS (SELECT c_custkey AS id, c_mktsegment || CASE c_custkey % 4 WHEN 0 THEN ' > Archiv' WHEN 1 THEN ' > Zápisy' ELSE '' END AS path FROM customer) SELECT split_part(path, ' > ', 1) AS organ, split_part(path, ' > ', 2) = 'Archiv' AS archived, COUNT(*) AS files, MIN(id) AS first FROM t GROUP BY 1, 2""")
def archive_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG08: an organ and whether its folder is the archive, out of one path."""
    k = F.col("c_custkey")
    path = F.concat("c_mktsegment", F.when(k % 4 == 0, " > Archiv").when(k % 4 == 1, " > Zápisy").otherwise(""))
    return table(spark, sf_dir, "customer").groupBy(F.split_part(path, F.lit(" > "), F.lit(1)).alias("organ"), (F.split_part(path, F.lit(" > "), F.lit(2)) == "Archiv").alias("archived")).agg(F.count(F.lit(1)).alias("files"), F.min("c_custkey").alias("first"))


@query("""WITH y AS (SELECT year(l_shipdate) AS year, l_suppkey % 20 AS section, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS spent FROM lineitem GROUP BY 1, 2), m AS (SELECT MAX(year) AS running FROM y), r AS (SELECT section, spent, row_number() OVER (ORDER BY spent DESC, section) AS place FROM y, m WHERE year = running - 1 AND spent > 0)
SELECT running - 1 AS closed, running, section, CAST(spent AS DOUBLE) AS spent, place FROM r, m WHERE place <= 8""")
def budget_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG09: the last closed year, the running one, and the eight largest sections of the closed one."""
    li = table(spark, sf_dir, "lineitem")
    running = li.agg(F.year(F.max("l_shipdate")).cast("long").alias("running"))  # one row
    y = li.groupBy(F.year("l_shipdate").cast("long").alias("year"), (F.col("l_suppkey") % 20).alias("section")).agg(F.sum(exact(F.col("l_extendedprice"))).alias("spent"))
    best = y.join(F.broadcast(running), F.col("year") == F.col("running") - 1).filter("spent > 0").orderBy(F.col("spent").desc(), "section").limit(8)
    place = F.row_number().over(Window.orderBy(F.col("spent").desc(), "section"))  # eight rows
    return best.select((F.col("running") - 1).alias("closed"), "running", "section", F.col("spent").cast("double").alias("spent"), place.cast("long").alias("place"))


@query("""WITH k AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'KV' WHEN 1 THEN 'KVMC' WHEN 2 THEN 'SENAT' ELSE 'X' END || year(o_orderdate) AS code FROM orders) SELECT CASE WHEN code LIKE 'SENAT%' THEN 'senate' WHEN code LIKE 'KVMC%' THEN 'district' WHEN code LIKE 'KV%' THEN 'town' END AS kind, CAST(regexp_extract(code, '([0-9]{4})$', 1) AS BIGINT) AS year, COUNT(*) AS cycles FROM k GROUP BY 1, 2""")
def election_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG11: the kind of an election by the longest prefix that fits, its year from its code."""
    k = F.col("o_orderkey")
    code = F.concat(F.when(k % 4 == 0, "KV").when(k % 4 == 1, "KVMC").when(k % 4 == 2, "SENAT").otherwise("X"), _s(F.year("o_orderdate")))
    kind = F.when(code.startswith("SENAT"), "senate").when(code.startswith("KVMC"), "district").when(code.startswith("KV"), "town")
    return table(spark, sf_dir, "orders").groupBy(kind.alias("kind"), F.regexp_extract(code, "([0-9]{4})$", 1).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("cycles"))


@query("""WITH h AS (SELECT p_type AS kind, p_partkey % 700 AS id, p_brand AS theme, p_partkey * 7 % 600 / 10.0 AS x FROM part) SELECT kind, id, arg_min(theme, (theme, x)) AS theme, COUNT(*) AS found, MIN(x) AS x FROM h WHERE x BETWEEN 5 AND 50 GROUP BY 1, 2""")
def theme_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG12: objects of several themes inside the boundary, each once, under its first theme."""
    k = F.col("p_partkey")
    h = table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), (k % 700).alias("id"), F.col("p_brand").alias("theme"), (k * 7 % 600 / 10).alias("x")).filter(F.col("x").between(5, 50))
    return h.groupBy("kind", "id").agg(F.min("theme").alias("theme"), F.count(F.lit(1)).alias("found"), F.min("x").alias("x"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS area FROM lineitem WHERE l_quantity > 49), b AS (SELECT p_partkey AS area FROM part WHERE p_partkey * 7 % 600 < 60) SELECT area, 'listed' AS found FROM a UNION ALL SELECT area, 'by place' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.area = b.area)""")
def area_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG13: areas of the code list, and those found by their place that it does not have, with where they come from."""
    a = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("area")).distinct()
    b = table(spark, sf_dir, "part").filter("p_partkey * 7 % 600 < 60").select(F.col("p_partkey").alias("area")).join(a, "area", "left_anti")
    return a.withColumn("found", F.lit("listed")).unionByName(b.withColumn("found", F.lit("by place")))


@query("""WITH r AS (SELECT doc_id, source, CASE WHEN text IS NULL OR length(text) < 200 THEN 'short' WHEN NOT regexp_matches(lower(text), 'the|der|les|los') THEN 'off topic' END AS reason, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS oldest, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS newest FROM documents)
SELECT source, COUNT(*) FILTER (WHERE reason IS NULL) AS kept, COUNT(*) FILTER (WHERE reason = 'short') AS short, COUNT(*) FILTER (WHERE reason = 'off topic') AS off_topic, COUNT(*) FILTER (WHERE reason IS NOT NULL AND (oldest <= 6 OR newest <= 2)) AS purged_in_sample FROM r GROUP BY 1""")
def reverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG16: stored rows against a tightened rule, what goes with its reason; the depth of an archive is measured on its six oldest and two newest rows."""
    text = F.col("text")
    reason = F.when(text.isNull() | (F.length(text) < 200), "short").when(~F.lower(text).rlike("the|der|les|los"), "off topic")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", reason.alias("reason"))
    counts = d.groupBy("source").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.coalesce(F.col("reason") == "short", F.lit(False))).alias("short"), F.count_if(F.coalesce(F.col("reason") == "off topic", F.lit(False))).alias("off_topic"))
    ends = top_k(d, ["source"], 6, F.col("doc_id")).drop("rank").unionByName(top_k(d, ["source"], 2, F.col("doc_id").desc()).drop("rank")).distinct()
    return counts.join(ends.groupBy("source").agg(F.count_if(F.col("reason").isNotNull()).alias("purged_in_sample")), "source")


@query("""WITH s AS (SELECT DISTINCT p_type AS name, p_size % 3 AS unit, CASE WHEN p_size % 2 = 0 THEN 'year' ELSE 'month' END AS every, p_brand AS breakdown FROM part) SELECT name, unit, every, COUNT(*) AS series, string_agg(breakdown, ',' ORDER BY breakdown) AS breakdowns, row_number() OVER (PARTITION BY name ORDER BY COUNT(*) DESC, unit, every) AS place FROM s GROUP BY 1, 2, 3""")
def indicator_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG21: series of one name, unit and period make one chart; those of more breakdowns come first."""
    s = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), (F.col("p_size") % 3).alias("unit"), F.when(F.col("p_size") % 2 == 0, "year").otherwise("month").alias("every"), F.col("p_brand").alias("breakdown")).distinct()
    g = s.groupBy("name", "unit", "every").agg(F.count(F.lit(1)).alias("series"), F.array_join(F.sort_array(F.collect_list("breakdown")), ",").alias("breakdowns"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.col("series").desc(), "unit", "every")).cast("long"))


@query("""WITH e AS (SELECT * FROM (VALUES ('orders'), ('part'), ('supplier'), ('minutes')) v(name)), f AS (SELECT 'orders' AS name, COUNT(*) AS n FROM orders UNION ALL SELECT 'part', COUNT(*) FROM part UNION ALL SELECT 'supplier', COUNT(*) FROM supplier UNION ALL SELECT 'nation', COUNT(*) FROM nation)
SELECT coalesce(e.name, f.name) AS name, n AS rows, CASE WHEN f.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected' WHEN n = 0 THEN 'empty' ELSE 'ok' END AS state FROM e FULL JOIN f ON f.name = e.name""")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG32: what a page reads and whether it is there: missing is not empty."""
    e = spark.createDataFrame([("orders",), ("part",), ("supplier",), ("minutes",)], "name string").withColumn("e", F.lit(True))
    f = None
    for name in ("orders", "part", "supplier", "nation"):
        one = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        f = one if f is None else f.unionByName(one)
    return e.join(f, "name", "full_outer").select("name", "rows", F.when(F.col("rows").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("rows") == 0, "empty").otherwise("ok").alias("state"))


@query("""WITH c AS (SELECT * FROM (VALUES ('income', 1), ('expense', 2), ('balance', 9)) v(name, code)), y AS (SELECT l_linenumber AS code, year(l_shipdate) AS year, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS approved, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag <> 'N') AS amended, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'F') AS actual FROM lineitem GROUP BY 1, 2)
SELECT name, z.year, CAST(approved AS DOUBLE) AS approved, CAST(amended AS DOUBLE) AS amended, CAST(actual AS DOUBLE) AS actual FROM c CROSS JOIN (SELECT DISTINCT year FROM y) z LEFT JOIN y ON y.code = c.code AND y.year = z.year""")
def budget_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ06: approved, amended and actual amounts of named lines; a line that is not there is unknown in all three."""
    money = exact(F.col("l_extendedprice"))
    y = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("code"), F.year("l_shipdate").cast("long").alias("year")).agg(F.sum(money).cast("double").alias("approved"), F.sum(F.when(F.col("l_returnflag") != "N", money)).cast("double").alias("amended"), F.sum(F.when(F.col("l_linestatus") == "F", money)).cast("double").alias("actual"))
    c = spark.createDataFrame([("income", 1), ("expense", 2), ("balance", 9)], "name string, code int")
    axis = y.select("year").distinct().crossJoin(F.broadcast(c))
    return axis.join(y, ["code", "year"], "left").select("name", "year", "approved", "amended", "actual")


@query("""WITH o AS (SELECT 'income' AS kind, o_orderkey AS item, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders WHERE year(o_orderdate) < 1998 AND o_orderstatus = 'O' UNION ALL SELECT 'expense', o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) FROM orders WHERE year(o_orderdate) < 1998 AND o_orderstatus = 'F'),
n AS (SELECT CASE WHEN substr(CAST(1000 + o_custkey AS VARCHAR), 1, 1) IN ('1', '2', '3', '4') THEN 'income' WHEN substr(CAST(1000 + o_custkey AS VARCHAR), 1, 1) IN ('5', '6') THEN 'expense' WHEN substr(CAST(1000 + o_custkey AS VARCHAR), 1, 1) = '8' THEN 'financing' END AS kind, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) FROM orders WHERE year(o_orderdate) >= 1998)
SELECT kind, COUNT(*) AS items, CAST(SUM(v) AS DOUBLE) AS total FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1""")
def two_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ07: statements of an older layout (a table for each kind) and a newer one (one table, the kind by the first digit of the item) as one."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", F.year("o_orderdate").alias("year"), exact(F.col("o_totalprice")).alias("v"))
    digit = F.substring(_s(F.col("o_custkey") + 1000), 1, 1)
    kind = F.when(digit.isin("1", "2", "3", "4"), "income").when(digit.isin("5", "6"), "expense").when(digit == "8", "financing")
    parts = [o.filter("year < 1998 and o_orderstatus = 'O'").select(F.lit("income").alias("kind"), "v"), o.filter("year < 1998 and o_orderstatus = 'F'").select(F.lit("expense").alias("kind"), "v"), o.filter("year >= 1998").select(kind.alias("kind"), "v")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("items"), F.sum("v").cast("double").alias("total"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS payer, o_custkey % 100 AS side, CASE WHEN o_totalprice >= 20000 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS price, o_orderpriority LIKE '%SPECIFIED%' AS lease, list(l_linenumber) AS issues FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT id, CASE WHEN payer % 7 = side % 7 THEN 'expense' ELSE 'income' END AS direction, CASE WHEN payer % 7 = side % 7 AND lease THEN 'inconclusive' ELSE 'reliable' END AS reliability, CAST(price AS DOUBLE) AS price, len(list_filter(issues, lambda i: i >= 6)) > 0 AS defect FROM s""")
def contract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ09: a contract's direction by who pays, how reliable that is, an unknown price, and whether any defect is grave."""
    issues = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("issues"))
    o = table(spark, sf_dir, "orders").join(issues, "o_orderkey", "left")
    expense = F.col("o_custkey") % 7 == F.col("o_custkey") % 100 % 7
    return o.select(F.col("o_orderkey").alias("id"), F.when(expense, "expense").otherwise("income").alias("direction"), F.when(expense & F.col("o_orderpriority").contains("SPECIFIED"), "inconclusive").otherwise("reliable").alias("reliability"), F.when(F.col("o_totalprice") >= 20000, exact(F.col("o_totalprice"))).cast("double").alias("price"), F.coalesce(F.exists("issues", lambda i: i >= 6), F.lit(False)).alias("defect"))


@query("""WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN p_name END AS a, p_type || ' (' || p_brand || ')' AS b, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN 'i.d.' ELSE CAST(p_size AS VARCHAR) END AS v, CASE WHEN p_size % 2 = 0 THEN 2000 + p_size || '' ELSE 2000 + p_size || '-0' || (1 + p_size % 9) END AS period FROM part)
SELECT id, trim(regexp_replace(coalesce(nullif(trim(a), ''), b), ' ?\\([^)]*\\)$', '')) AS indicator, nullif(regexp_extract(coalesce(nullif(trim(a), ''), b), '\\(([^)]*)\\)$', 1), '') AS unit, try_cast(v AS DOUBLE) AS value, coalesce(v = 'i.d.', false) AS confidential, CASE WHEN length(period) = 4 THEN 'year' ELSE 'month' END AS every FROM r""")
def statistical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ11: records of a long statistical format: the first column that is filled, the unit split off, blank and confidential values unknown."""
    k, size = F.col("p_partkey"), F.col("p_size")
    a = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.col("p_name"))
    name = F.coalesce(F.nullif(F.trim(a), F.lit("")), F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")")))
    v = F.when(k % 5 == 0, "").when(k % 5 == 1, "i.d.").otherwise(_s(size))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.trim(F.regexp_replace(name, " ?\\([^)]*\\)$", "")).alias("indicator"), F.nullif(F.regexp_extract(name, "\\(([^)]*)\\)$", 1), F.lit("")).alias("unit"), v.try_cast("double").alias("value"), (v == "i.d.").alias("confidential"), F.when(size % 2 == 0, "year").otherwise("month").alias("every"))


@query("""WITH e AS (SELECT l_suppkey AS firm, l_partkey % 97 AS person, CAST(l_shipdate AS DATE) AS entered, CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) + 400 END AS deleted, l_linenumber AS role FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY firm, person ORDER BY deleted IS NULL DESC, entered DESC, role DESC) AS n FROM e)
SELECT lpad(CAST(firm AS VARCHAR), 8, '0') AS firm, person, CAST(entered AS VARCHAR) AS since, deleted IS NULL AS live, role FROM r WHERE n = 1""")
def engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ13: the version of a register entry that counts: the one not deleted, else the latest."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("firm"), (F.col("l_partkey") % 97).alias("person"), F.to_date("l_shipdate").alias("entered"), (F.col("l_returnflag") != "R").alias("live"), F.col("l_linenumber").alias("role"))
    best = e.groupBy("firm", "person").agg(F.max(F.struct("live", "entered", "role")).alias("x"))
    return best.select(F.lpad(_s(F.col("firm")), 8, "0").alias("firm"), "person", _s(F.col("x.entered")).alias("since"), F.col("x.live").alias("live"), F.col("x.role").alias("role"))


@query(f"""WITH {CONTRACTS}, m AS (SELECT party, CAST(SUM(amount) AS DOUBLE) AS traded FROM contracts GROUP BY 1) SELECT c_custkey AS person, CASE WHEN c_custkey % 6 > 0 THEN c_custkey END AS firm, CASE WHEN s_suppkey IS NOT NULL THEN 'entity' WHEN traded IS NOT NULL THEN 'trades' ELSE 'none' END AS relation, traded FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND c_custkey % 6 > 0 LEFT JOIN m ON m.party = c_custkey AND c_custkey % 6 > 0""")
def firm_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ15: a person's firm with its register entry and its trade; without a usable identity all of it is unknown."""
    m = contracts(spark, sf_dir).groupBy(F.col("party").alias("firm")).agg(total(F.col("amount")).alias("traded"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("firm"), F.lit(True).alias("entity"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.when(F.col("c_custkey") % 6 > 0, F.col("c_custkey")).alias("firm"))
    relation = F.when(F.col("entity"), "entity").when(F.col("traded").isNotNull(), "trades").otherwise("none")
    return p.join(s, "firm", "left").join(m, "firm", "left").select("person", "firm", relation.alias("relation"), "traded")


@query("""WITH h AS (SELECT p_partkey AS id, p_brand || ';' || p_type AS towns, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 60 / 1.0 END AS x_main, p_size / 2.0 AS x_other, -100000000000 * (p_size % 30) AS ms FROM part) SELECT id, coalesce(x_main, x_other) AS x, CASE WHEN x_main IS NULL THEN 'indirect' ELSE 'main' END AS point, year(make_timestamp(ms * 1000)) AS year FROM h WHERE list_contains(string_split(towns, ';'), 'Brand#7') OR list_contains(string_split(towns, ';'), 'ECONOMY')""")
def heritage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ18: records of a town that stands in a list of towns; the main point before an indirect one; years before 1970, too."""
    k, size = F.col("p_partkey"), F.col("p_size")
    towns = F.split(F.concat_ws(";", "p_brand", "p_type"), ";")
    main = F.when(k % 3 == 0, (k % 60).cast("double"))
    year = F.year(F.timestamp_millis(F.lit(-100000000000) * (size % 30)))
    return table(spark, sf_dir, "part").filter(F.array_contains(towns, "Brand#7") | F.array_contains(towns, "ECONOMY")).select(k.alias("id"), F.coalesce(main, size / 2.0).alias("x"), F.when(main.isNull(), "indirect").otherwise("main").alias("point"), year.cast("long").alias("year"))


@query("""WITH d AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'xml' ELSE 'html' END AS format, regexp_replace(url, '^[a-z]+://([^/]*).*$', '\\1') AS name FROM pages) SELECT name, arg_min(url, (CASE format WHEN 'csv' THEN 0 ELSE 1 END, page_id)) AS source, COUNT(*) AS offered FROM d WHERE regexp_matches(name, '^(?:blog|www|m)[.]th[a-z]*[.]example[.](?:net|com)$') AND format <> 'html' GROUP BY 1""")
def catalogue_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19: data sets of a catalogue whose whole name fits a pattern, and of each the distribution of the best format."""
    form = F.when(F.col("page_id") % 3 == 0, "csv").when(F.col("page_id") % 3 == 1, "xml").otherwise("html")
    d = table(spark, sf_dir, "pages").select("page_id", "url", form.alias("format"), F.regexp_replace("url", "^[a-z]+://([^/]*).*$", "$1").alias("name"))
    kept = d.filter(F.col("name").rlike("^(?:blog|www|m)[.]th[a-z]*[.]example[.](?:net|com)$") & (F.col("format") != "html"))
    return kept.groupBy("name").agg(F.min_by("url", F.struct(F.when(F.col("format") == "csv", 0).otherwise(1), "page_id")).alias("source"), F.count(F.lit(1)).alias("offered"))


@query("""SELECT s_suppkey AS id, s_name AS name, s_nationkey = 3 AS outside FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 5 > 0""")
def watched_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC23: entities that are watched and have an id; those outside the town are marked."""
    s = table(spark, sf_dir, "supplier").withColumn("id", F.when(F.col("s_suppkey") % 5 > 0, F.col("s_suppkey")))
    return s.filter((F.col("s_acctbal") > 0) & F.col("id").isNotNull()).select("id", F.col("s_name").alias("name"), (F.col("s_nationkey") == 3).alias("outside"))


@query("""WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, COUNT(*) AS items, COUNT(DISTINCT event_type) AS sections, MAX(ts) AS made FROM events GROUP BY 1) SELECT CAST(week AS VARCHAR) AS issue, items, sections, row_number() OVER (ORDER BY week DESC) AS place FROM w""")
def issue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK05: headers of the issues, newest first. Issues fold to one row for each week before they are numbered."""
    w = table(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count(F.lit(1)).alias("items"), F.countDistinct("event_type").alias("sections"))
    return w.select(_s(F.col("week")).alias("issue"), "items", "sections", F.row_number().over(Window.orderBy(F.col("week").desc())).cast("long").alias("place"))


@query("""SELECT o_custkey AS party, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS name, CAST(MAX(o_orderdate)::DATE AS VARCHAR) AS day, COUNT(DISTINCT o_orderpriority) AS names FROM orders GROUP BY 1""")
def latest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN10: the name in a party's latest record stands for it."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("party")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("name"), _s(F.to_date(F.max("o_orderdate"))).alias("day"), F.countDistinct("o_orderpriority").alias("names"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, p_name, s_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5 LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def surrogate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN01: rows with what their ids stand for; an unknown id leaves null."""
    p = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return table(spark, sf_dir, "lineitem").join(p, "l_partkey", "left").join(s, "l_suppkey", "left").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "p_name", "s_name")
