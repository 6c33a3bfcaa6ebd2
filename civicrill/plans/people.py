"""Persons, companies and the links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicrill.functions import text as T
from civicrill.functions.numbers import exact, ratio
from civicrill.operators.keyed import places, top_k
from civicrill.plans.registry import query
from civicrill.sources.tables import spread, table


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS base, CASE WHEN p_size % 4 > 0 THEN p_size END AS born FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY born NULLS LAST, id) AS n FROM p), u AS (SELECT base, COUNT(DISTINCT born) = 1 AS one FROM p GROUP BY 1)
SELECT id, replace(base, ' ', '-') || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS key, one AS unambiguous FROM r JOIN u USING (base)""")
def homonym_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN21: persons of one name get numbered keys in the order of birth, unknown last."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("base"), F.when(F.col("p_size") % 4 > 0, F.col("p_size")).alias("born"))
    n = F.row_number().over(Window.partitionBy("base").orderBy(F.col("born").asc_nulls_last(), "id"))
    one = p.groupBy("base").agg((F.countDistinct("born") == 1).alias("unambiguous"))
    return p.withColumn("n", n).join(one, "base").select("id", F.concat(F.replace("base", F.lit(" "), F.lit("-")), F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise("")).alias("key"), "unambiguous")


@query("""WITH a AS (SELECT s_suppkey AS id, s_nationkey AS place, s_suppkey % 40 AS name FROM supplier), b AS (SELECT c_custkey AS cid, c_nationkey AS place, c_custkey % 40 AS name FROM customer),
n AS (SELECT id, COUNT(*) AS hits, MIN(cid) AS least_cid, COUNT(*) FILTER (WHERE a.place = b.place) AS shared, MIN(cid) FILTER (WHERE a.place = b.place) AS by_place FROM a JOIN b USING (name) GROUP BY 1)
SELECT a.id, CASE WHEN hits = 1 THEN least_cid WHEN shared = 1 THEN by_place END AS assigned, CASE WHEN hits IS NULL THEN 'not found' WHEN hits = 1 THEN 'probable' WHEN shared = 1 THEN 'confirmed' ELSE 'ambiguous' END AS status FROM a LEFT JOIN n ON n.id = a.id""")
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN20: an identity is assigned only if unique, or if one candidate shares further evidence."""
    return _identities(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"))


def _identities(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    """Candidates are counted by name, and by name and place, before they meet: no pairs are made."""
    a = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("place"), (F.col("s_suppkey") % 40).alias("name"))
    b = customer.select(F.col("c_custkey").alias("cid"), F.col("c_nationkey").alias("place"), (F.col("c_custkey") % 40).alias("name"))
    named = b.groupBy("name").agg(F.count(F.lit(1)).alias("hits"), F.min("cid").alias("least_cid"))
    placed = b.groupBy("name", "place").agg(F.count(F.lit(1)).alias("shared"), F.min("cid").alias("by_place"))
    status = F.when(F.col("hits").isNull(), "not found").when(F.col("hits") == 1, "probable").when(F.col("shared") == 1, "confirmed").otherwise("ambiguous")
    return a.join(named, "name", "left").join(placed, ["name", "place"], "left").select("id", F.when(F.col("hits") == 1, F.col("least_cid")).when(F.col("shared") == 1, F.col("by_place")).alias("assigned"), status.alias("status"))


@query("""WITH o AS (SELECT DISTINCT p_brand AS organ, p_type AS word FROM part), m AS (SELECT DISTINCT 'Brand#' || (p_size % 30) AS organ, p_type AS word FROM part), s AS (SELECT m.organ AS minutes, o.organ AS board, COUNT(*) AS shared FROM m JOIN o USING (word) GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY minutes ORDER BY shared DESC) AS r FROM s), b AS (SELECT minutes, CASE WHEN COUNT(*) = 1 THEN MIN(board) END AS board FROM r WHERE r = 1 GROUP BY 1)
SELECT n.organ AS minutes, coalesce(e.organ, b.board) AS board, CASE WHEN e.organ IS NOT NULL THEN 'exact' WHEN b.board IS NOT NULL THEN 'words' ELSE 'unmatched' END AS how FROM (SELECT DISTINCT organ FROM m) n LEFT JOIN (SELECT DISTINCT organ FROM o) e ON e.organ = n.organ LEFT JOIN b ON b.minutes = n.organ""")
def organ_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN18: the exact name first, else most shared words; a tie stays unmatched."""
    p = table(spark, sf_dir, "part")
    return _organs(p, p)


def _organs(boards: DataFrame, minutes: DataFrame) -> DataFrame:
    o = boards.select(F.col("p_brand").alias("board"), F.col("p_type").alias("word")).distinct()
    m = minutes.select(F.concat(F.lit("Brand#"), (F.col("p_size") % 30).cast("string")).alias("minutes"), F.col("p_type").alias("word")).distinct()
    s = m.join(o, "word").groupBy("minutes", "board").agg(F.count(F.lit(1)).alias("shared"))
    r = s.withColumn("r", F.rank().over(Window.partitionBy("minutes").orderBy(F.col("shared").desc()))).filter("r = 1")
    b = r.groupBy("minutes").agg(F.when(F.count(F.lit(1)) == 1, F.min("board")).alias("by_words"))
    exact_name = o.select(F.col("board").alias("minutes"), F.col("board").alias("same")).distinct()
    out = m.select("minutes").distinct().join(exact_name, "minutes", "left").join(b, "minutes", "left")
    return out.select("minutes", F.coalesce("same", "by_words").alias("board"), F.when(F.col("same").isNotNull(), "exact").when(F.col("by_words").isNotNull(), "words").otherwise("unmatched").alias("how"))


@query("""WITH k AS (SELECT c_custkey AS k, CAST(c_acctbal AS DECIMAL(18,2)) AS v, 'customer 0000' || (c_custkey % 50) AS core FROM customer), q AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS by_id, 'customer 0000' || (s_suppkey % 60) AS core FROM supplier),
i AS (SELECT id, SUM(v) AS s, COUNT(*) AS n FROM q JOIN k ON k.k = q.by_id GROUP BY 1), e AS (SELECT id, SUM(v) AS s, COUNT(*) AS n FROM q JOIN k USING (core) GROUP BY 1)
SELECT q.id, CAST(coalesce(i.s, e.s) AS DOUBLE) AS traded, coalesce(i.n, e.n) AS rows, CASE WHEN i.s IS NOT NULL THEN 'id' WHEN e.s IS NOT NULL THEN 'name' ELSE 'none' END AS matched FROM q LEFT JOIN i ON i.id = q.id LEFT JOIN e ON e.id = q.id""")
def cascaded_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN19: by id, else by name with all hits summed; the kind of match is recorded."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), exact(F.col("c_acctbal")).alias("v"), F.concat(F.lit("customer 0000"), (F.col("c_custkey") % 50).cast("string")).alias("core"))
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")).alias("by_id"), F.concat(F.lit("customer 0000"), (F.col("s_suppkey") % 60).cast("string")).alias("core"))
    i = k.select(F.col("k").alias("by_id"), F.col("v").alias("a"), F.lit(1).cast("long").alias("a_n"))
    e = k.groupBy("core").agg(F.sum("v").alias("b"), F.count(F.lit(1)).alias("b_n"))
    out = q.join(i, "by_id", "left").join(e, "core", "left")
    return out.select("id", F.coalesce(F.col("a").cast("double"), F.col("b").cast("double")).alias("traded"), F.coalesce("a_n", "b_n").alias("rows"), F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "name").otherwise("none").alias("matched"))


@query("""WITH m AS (SELECT doc_id, item_id FROM documents, (SELECT item_id, string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), ' ')[1:6] AS w FROM benchmark) b WHERE len(w) = 6 AND contains(' ' || trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || array_to_string(w, ' ') || ' ')) SELECT item_id, COUNT(*) AS mentions, MIN(doc_id) AS first_doc FROM m GROUP BY 1""")
def mention_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN22, PG03: texts that mention a name: an equi join on the hash of six words instead of comparing all pairs, then the phrase itself.

    Only ids and hashes are exploded; texts meet the few pairs that are left, by a broadcast of the pairs where Spark finds them small.
    """
    six = lambda w, i=0: F.xxhash64(*[w[i + k] for k in range(6)])
    names = table(spark, sf_dir, "benchmark").select("item_id", F.slice(T.word_list(F.col("text")), 1, 6).alias("w")).filter(F.size("w") == 6).select("item_id", F.array_join("w", " ").alias("phrase"), six(F.col("w")).alias("h"))
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = d.select("doc_id", F.split(T.word_string(F.col("text")), " ").alias("w")).filter(F.size("w") >= 6)
    grams = words.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 6), lambda i: six(F.col("w"), i))).alias("h"))
    pairs = grams.join(names, "h").select("doc_id", "item_id", "phrase").distinct()
    said = d.select("doc_id", F.concat(F.lit(" "), T.word_string(F.col("text")), F.lit(" ")).alias("said"))
    hits = pairs.join(said, "doc_id").filter(F.col("said").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))).select("doc_id", "item_id").distinct()
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("mentions"), F.min("doc_id").alias("first_doc"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS firm, l_partkey % 97 AS person FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), b AS (SELECT DISTINCT l_suppkey AS firm, l_partkey % 97 AS person FROM lineitem WHERE l_linestatus = 'O' AND l_quantity < 3)
SELECT coalesce(a.firm, b.firm) AS firm, coalesce(a.person, b.person) AS person, concat_ws('+', CASE WHEN a.firm IS NOT NULL THEN 'role' END, CASE WHEN b.firm IS NOT NULL THEN 'trade' END) AS evidence FROM a FULL JOIN b ON a.firm = b.firm AND a.person = b.person""")
def supplier_person_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN23: two kinds of evidence for one link, merged."""
    li = table(spark, sf_dir, "lineitem")
    pair = [F.col("l_suppkey").alias("firm"), (F.col("l_partkey") % 97).alias("person")]
    a = li.filter("l_returnflag = 'R' and l_quantity > 45").select(*pair).distinct().withColumn("a", F.lit("role"))
    b = li.filter("l_linestatus = 'O' and l_quantity < 3").select(*pair).distinct().withColumn("b", F.lit("trade"))
    return a.join(b, ["firm", "person"], "full_outer").select("firm", "person", F.concat_ws("+", "a", "b").alias("evidence"))


@query("""WITH o AS (SELECT l_suppkey AS firm, l_partkey % 31 AS person, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, MAX(l_shipdate) >= TIMESTAMP '2001-06-01' AS today FROM lineitem GROUP BY 1, 2)
SELECT person, CAST(SUM(s) FILTER (WHERE today) AS DOUBLE) AS today_total, CAST(SUM(s) FILTER (WHERE NOT today) AS DOUBLE) AS former_total, COUNT(*) FILTER (WHERE today) AS firms_today, string_agg(CAST(firm AS VARCHAR), ',' ORDER BY firm) AS firms FROM o GROUP BY 1""")
def trade_of_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10, AR06, PG07: firms turned into a view by person, today apart from before; without firms the sum is unknown."""
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("firm"), (F.col("l_partkey") % 31).alias("person")).agg(F.sum(exact(F.col("l_extendedprice"))).alias("s"), (F.max("l_shipdate") >= F.lit("2001-06-01").cast("timestamp")).alias("today"))
    return o.groupBy("person").agg(
        F.sum(F.when(F.col("today"), F.col("s"))).cast("double").alias("today_total"),
        F.sum(F.when(~F.col("today"), F.col("s"))).cast("double").alias("former_total"),
        F.count_if("today").alias("firms_today"),
        F.array_join(F.array_sort(F.collect_list("firm")).cast("array<string>"), ",").alias("firms"),
    )


@query("""WITH e AS (SELECT user_id AS person, event_type AS state, 'Member ' || repeat('x', CAST(user_id % 3 AS INTEGER)) || (user_id % 50) AS shown FROM events), n AS (SELECT person % 50 AS who, COUNT(*) AS named, COUNT(*) FILTER (WHERE state = 'view') AS present, COUNT(*) FILTER (WHERE state = 'error') AS excused, arg_max(shown, (length(shown), shown)) AS display FROM e GROUP BY 1) SELECT who, named, present, excused, present / named AS share, display FROM n""")
def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG23: attendance of those named; the longest form of a name is shown."""
    shown = F.concat(F.lit("Member "), F.repeat(F.lit("x"), (F.col("user_id") % 3).cast("int")), (F.col("user_id") % 50).cast("string"))
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("who"), F.col("event_type").alias("state"), shown.alias("shown"))
    present = F.count_if(F.col("state") == "view")
    return e.groupBy("who").agg(F.count(F.lit(1)).alias("named"), present.alias("present"), F.count_if(F.col("state") == "error").alias("excused"), ratio(present, F.count(F.lit(1))).alias("share"), F.max_by("shown", F.struct(F.length("shown"), "shown")).alias("display"))


@query("""WITH g AS (SELECT c_nationkey AS recipient, o_orderpriority AS funder, CASE WHEN o_totalprice >= 100000 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount FROM orders JOIN customer ON c_custkey = o_custkey) SELECT recipient, COUNT(*) AS grants, COUNT(amount) AS priced, CAST(SUM(amount) AS DOUBLE) AS total, string_agg(DISTINCT funder, ',' ORDER BY funder) AS funders FROM g GROUP BY 1""")
def grants_per_recipient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG31, PJ10: grants counted with unpriced ones, summed without, funders named once."""
    return _grants(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def _grants(o: DataFrame, c: DataFrame) -> DataFrame:
    g = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("recipient"), F.col("o_orderpriority").alias("funder"), F.when(F.col("o_totalprice") >= 100000, exact(F.col("o_totalprice"))).alias("amount"))
    return g.groupBy("recipient").agg(F.count(F.lit(1)).alias("grants"), F.count("amount").alias("priced"), F.sum("amount").cast("double").alias("total"), F.array_join(F.array_sort(F.collect_set("funder")), ",").alias("funders"))


@query("""WITH e AS (SELECT p_partkey % 12 AS a, p_size % 15 AS b, COUNT(*) AS w FROM part GROUP BY 1, 2), x AS (SELECT a, AVG(CAST(b AS DOUBLE)) AS m FROM e GROUP BY 1), pa AS (SELECT a, row_number() OVER (ORDER BY m, a) AS p FROM x), y AS (SELECT b, AVG(CAST(p AS DOUBLE)) AS m FROM e JOIN pa USING (a) GROUP BY 1) SELECT 'right' AS side, b AS node, row_number() OVER (ORDER BY m, b) AS place FROM y UNION ALL SELECT 'left', a, p FROM pa""")
def barycentre_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG29: both sides of a small bipartite drawing ordered by the mean place of their neighbours."""
    e = table(spark, sf_dir, "part").select((F.col("p_partkey") % 12).alias("a"), (F.col("p_size") % 15).cast("long").alias("b")).distinct()
    place = lambda m, n: F.row_number().over(Window.orderBy(m, n)).cast("long")  # noqa: E731  nodes of one drawing
    left = e.groupBy("a").agg(F.avg(F.col("b").cast("double")).alias("m")).select("a", place("m", "a").alias("p"))
    right = e.join(left, "a").groupBy("b").agg(F.avg(F.col("p").cast("double")).alias("m")).select("b", place("m", "b").alias("p"))
    return left.select(F.lit("left").alias("side"), F.col("a").alias("node"), F.col("p").alias("place")).unionByName(right.select(F.lit("right").alias("side"), F.col("b").alias("node"), F.col("p").alias("place")))


@query("""WITH m AS (SELECT l_orderkey AS meeting, l_suppkey % 20 AS member, arg_min(l_returnflag, (l_linenumber, l_partkey, l_returnflag)) AS party FROM lineitem GROUP BY 1, 2) SELECT member, party, COUNT(*) AS meetings FROM m GROUP BY 1, 2""")
def sampled_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN26, PG14: an attribute read from one vote of a meeting holds for the whole meeting."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("meeting"), (F.col("l_suppkey") % 20).alias("member")).agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_returnflag")).alias("party"))
    return m.groupBy("member", "party").agg(F.count(F.lit(1)).alias("meetings"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS kind, s_acctbal, CASE WHEN s_acctbal < 0 THEN 'closed' WHEN s_suppkey % 7 = 0 THEN 'in liquidation' WHEN s_acctbal > 5000 THEN 'active' END AS state FROM supplier) SELECT id, state, coalesce(state, 'unknown') AS shown, row_number() OVER (PARTITION BY kind ORDER BY coalesce(s_acctbal, 0) DESC, id) AS place FROM s""")
def company_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ08, SO01: a state by precedence, unknown when nothing tells; mixed order with a unique tie-breaker."""
    state = F.when(F.col("s_acctbal") < 0, "closed").when(F.col("s_suppkey") % 7 == 0, "in liquidation").when(F.col("s_acctbal") > 5000, "active")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", F.coalesce("s_acctbal", F.lit(0.0)).alias("balance"), state.alias("state"), F.coalesce(state, F.lit("unknown")).alias("shown"))
    return places(rows, ["s_nationkey"], F.desc("balance"), F.col("id")).select("id", "state", "shown", "place")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS a, o_orderpriority AS b FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS rank FROM e) SELECT a, b, rank FROM r WHERE rank <= 3""")
def capped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG33: edges of a drawing, a fixed number for each node."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("b")).distinct()
    return top_k(e, ["a"], 3, F.col("b")).withColumn("rank", F.col("rank").cast("long"))
