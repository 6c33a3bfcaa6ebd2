"""Meetings and what follows from them: ballots, totals, documented links, certainty, coverage of parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicrill.functions.numbers import exact, total
from civicrill.operators.keyed import first_by, top_k
from civicrill.plans.money import CANDIDATES, candidates
from civicrill.plans.registry import query
from civicrill.plans.standins import CONTRACTS, contracts
from civicrill.sources.tables import table

#: Organs of the stand-in.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
CERTAINTY = ("low", "medium", "high")


def percent(part: Column, whole: Column) -> Column:
    """Two decimals, halves up; null when the whole is zero."""
    return F.floor(F.try_divide(part.cast("double") * 10000, whole.cast("double")) + 0.5) / 100


PERCENT = "floor({0} * 10000.0 / nullif({1}, 0) + 0.5) / 100"


@query("""WITH b AS (SELECT l_orderkey AS meeting, l_returnflag AS vote, CASE l_linenumber % 4 WHEN 0 THEN 'absent?' WHEN 1 THEN 'for' WHEN 2 THEN 'against' ELSE 'abstained' END AS state FROM lineitem)
SELECT meeting, vote, COUNT(*) FILTER (WHERE state <> 'absent?') AS ballots, COUNT(*) FILTER (WHERE state = 'absent?') AS unknown, COUNT(*) FILTER (WHERE state = 'for') AS in_favour, COUNT(*) FILTER (WHERE state <> 'absent?') = 0 AS skipped FROM b GROUP BY 1, 2""")
def vote_ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ02: the ballots of meetings and their votes; unknown states are counted and dropped, votes without ballots are marked."""
    state = F.when(F.col("l_linenumber") % 4 == 0, "absent?").when(F.col("l_linenumber") % 4 == 1, "for").when(F.col("l_linenumber") % 4 == 2, "against").otherwise("abstained")
    flat = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting"), F.col("l_returnflag").alias("vote"), state.alias("state"))
    known = F.col("state").isin("for", "against", "abstained")
    counts = F.count_if(known).alias("ballots"), F.count_if(~known).alias("unknown"), F.count_if(F.col("state") == "for").alias("in_favour")
    return flat.groupBy("meeting", "vote").agg(*counts, (F.count_if(known) == 0).alias("skipped"))


@query(f"""WITH p AS (SELECT year(o_orderdate) AS cycle, c_nationkey AS precinct, COUNT(*) AS listed, COUNT(*) FILTER (WHERE o_orderstatus <> 'P') AS cast_votes, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS valid FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT cycle, COUNT(*) AS precincts, CAST(SUM(listed) AS BIGINT) AS listed, CAST(SUM(cast_votes) AS BIGINT) AS cast_votes, CAST(SUM(valid) AS BIGINT) AS valid, {PERCENT.format("SUM(cast_votes)", "SUM(listed)")} AS turnout, {PERCENT.format("SUM(valid)", "SUM(cast_votes)")} AS valid_share FROM p GROUP BY 1""")
def vote_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG25: precincts summed to an election; shares are null where the whole is zero."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    p = o.groupBy(F.year("o_orderdate").cast("long").alias("cycle"), F.col("c_nationkey").alias("precinct")).agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("o_orderstatus") != "P").alias("b"), F.count_if(F.col("o_orderstatus") == "F").alias("c"))
    return p.groupBy("cycle").agg(F.count(F.lit(1)).alias("precincts"), F.sum("a").alias("listed"), F.sum("b").alias("cast_votes"), F.sum("c").alias("valid"), percent(F.sum("b"), F.sum("a")).alias("turnout"), percent(F.sum("c"), F.sum("b")).alias("valid_share"))


@query("""WITH l AS (SELECT year(l_shipdate) AS cycle, 'candidate ' || l_linenumber AS candidate, CAST(SUM(l_quantity) AS BIGINT) AS votes FROM lineitem GROUP BY 1, 2)
SELECT cycle, candidate, votes, rank() OVER (PARTITION BY cycle ORDER BY votes DESC) AS place FROM l WHERE votes > 0""")
def election_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ12: a wide table with a column of votes for each candidate turned into records with places."""
    numbers = range(1, 8)
    wide = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("cycle")).agg(*[F.sum(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).cast("long").alias(f"candidate {i}") for i in numbers])
    long = wide.unpivot("cycle", [f"candidate {i}" for i in numbers], "candidate", "votes").filter("votes > 0")
    return top_k(long, ["cycle"], len(numbers), F.col("votes").desc(), F.col("candidate")).groupBy("cycle").agg(F.collect_list(F.struct("candidate", "votes")).alias("all")).select("cycle", "all", F.explode("all").alias("x")).select("cycle", "x.candidate", "x.votes", (F.size(F.filter("all", lambda y: y["votes"] > F.col("x.votes"))) + 1).cast("long").alias("place"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, pos, ls[pos] AS line FROM l),
k AS (SELECT *, CASE WHEN contains(line, 'Licensed under') THEN 'licensed' WHEN contains(line, 'Released under') THEN 'released' WHEN contains(line, 'token') THEN 'credential' WHEN contains(line, '@') THEN 'contact' WHEN contains(line, '|') THEN 'table' END AS direction FROM p)
SELECT doc_id || '-' || pos AS id, direction FROM k WHERE direction IS NOT NULL AND NOT contains(line, '###')""")
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG04: resolutions of the minutes by place; those of a known direction stay, what was not adopted goes. An id is minutes and place."""
    line = F.col("line")
    kind = F.when(line.contains("Licensed under"), "licensed").when(line.contains("Released under"), "released").when(line.contains("token"), "credential").when(line.contains("@"), "contact").when(line.contains("|"), "table")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.withColumn("direction", kind).filter(F.col("direction").isNotNull() & ~line.contains("###")).select(F.concat(F.col("doc_id").cast("string"), F.lit("-"), (F.col("p") + 1).cast("string")).alias("id"), "direction")


POINTS = f"""points AS (SELECT l_orderkey AS number, l_linenumber AS line, CASE l_linenumber % 5 {" ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PRIORITIES))} END AS organ, CAST(l_shipdate AS DATE) AS day, CAST(l_shipdate AS DATE) - CAST(l_quantity % 5 AS INTEGER) * 90 AS named FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """number, line, organ, day and the day that a point's text names."""
    organ = F.element_at(F.array(*map(F.lit, PRIORITIES)), F.col("l_linenumber") % 5 + 1)
    day = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number"), F.col("l_linenumber").alias("line"), organ.alias("organ"), day.alias("day"), F.date_sub(day, (F.col("l_quantity") % 5).cast("int") * 90).alias("named"))


@query(f"""WITH {POINTS}, d AS (SELECT DISTINCT * FROM points), m AS (SELECT o_orderpriority AS organ, CAST(o_orderdate AS DATE) AS named, COUNT(*) AS n, MIN(o_orderkey) AS meeting FROM orders GROUP BY 1, 2)
SELECT number, line, d.organ, CAST(named AS VARCHAR) AS named, CASE WHEN n = 1 THEN meeting END AS meeting, day - named AS gap, n = 1 AS documented FROM d JOIN m USING (organ, named) WHERE day - named BETWEEN 0 AND 365""")
def documented_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10: a point that names an organ and a day is linked to the one meeting of that organ on that day, up to a year before; several meetings are no link, and are told. Meetings are counted before they meet the points."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("organ"), F.to_date("o_orderdate").alias("named")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("meeting"))
    gap = F.datediff("day", "named").cast("long")
    linked = points(spark, sf_dir).distinct().filter(gap.between(0, 365)).join(m, ["organ", "named"])
    return linked.select("number", "line", "organ", F.col("named").cast("string").alias("named"), F.when(F.col("n") == 1, F.col("meeting")).alias("meeting"), gap.alias("gap"), (F.col("n") == 1).alias("documented"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS number, l_suppkey % 5 AS organ FROM lineitem WHERE l_returnflag = 'R') SELECT o_orderkey AS number, s.number IS NOT NULL AS same_meeting FROM orders LEFT JOIN s ON s.number = o_orderkey AND s.organ = o_custkey % 5""")
def same_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12: whether the minutes of the same organ and number hold the point, as a flag on each row."""
    s = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("number"), (F.col("l_suppkey") % 5).alias("organ")).distinct().withColumn("there", F.lit(True))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), (F.col("o_custkey") % 5).alias("organ"))
    return o.join(s, ["number", "organ"], "left").select("number", F.col("there").isNotNull().alias("same_meeting"))


LINKS = """links AS (SELECT l_orderkey AS chain, l_suppkey AS party, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS rank FROM lineitem)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chain"), F.col("l_suppkey").alias("party"), exact(F.col("l_extendedprice")).alias("amount"), rank.alias("rank"))


def _named(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CERTAINTY)), rank + 1)


@query(f"""WITH {LINKS} SELECT chain, CASE MIN(rank) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS certainty, COUNT(*) AS parts FROM links GROUP BY 1""")
def weakest_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN11: a chain is as certain as its weakest part."""
    return links(spark, sf_dir).groupBy("chain").agg(_named(F.min("rank")).alias("certainty"), F.count(F.lit(1)).alias("parts"))


@query(f"""WITH {LINKS}, c AS (SELECT chain, MIN(rank) AS rank, MAX(amount) AS value, SUM(amount) AS naive, COUNT(*) AS n FROM links GROUP BY 1), p AS (SELECT c.rank, COUNT(DISTINCT party) AS parties FROM links JOIN c USING (chain) GROUP BY 1)
SELECT CASE rank WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS certainty, COUNT(*) AS chains, CAST(SUM(n) AS BIGINT) AS links, MAX(parties) AS parties, CAST(SUM(value) AS DOUBLE) AS value, CAST(SUM(naive) AS DOUBLE) AS naive_sum FROM c JOIN p USING (rank) GROUP BY rank""")
def certainty_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: chains by certainty, linked parties, and their value (the largest part) beside the naive sum."""
    each = links(spark, sf_dir)
    c = each.groupBy("chain").agg(F.min("rank").alias("rank"), F.max("amount").alias("value"), F.sum("amount").alias("naive"), F.count(F.lit(1)).alias("n"))
    parties = each.select("chain", "party").join(c.select("chain", "rank"), "chain").groupBy("rank").agg(F.countDistinct("party").alias("parties"))
    s = c.groupBy("rank").agg(F.count(F.lit(1)).alias("chains"), F.sum("n").alias("links"), F.sum("value").cast("double").alias("value"), F.sum("naive").cast("double").alias("naive_sum"))
    return s.join(parties, "rank").select(_named(F.col("rank")).alias("certainty"), "chains", "links", "parties", "value", "naive_sum")


REASON = """CASE WHEN text IS NULL OR length(text) < 40 THEN 'empty' WHEN length(text) - length(replace(replace(replace(text, '#', ''), '$', ''), '%', '')) > 0.05 * length(text) THEN 'symbols' WHEN NOT contains(text, '. ') AND NOT contains(text, chr(10)) THEN 'no sentences' END"""


def reason(text: Column) -> Column:
    """Why a text could not be parsed; null when it could."""
    symbols = F.length(text) - F.length(F.translate(text, "#$%", ""))
    return F.when(text.isNull() | (F.length(text) < 40), "empty").when(symbols > 0.05 * F.length(text), "symbols").when(~text.contains(". ") & ~text.contains("\n"), "no sentences")


@query(f"SELECT doc_id, {REASON} AS reason FROM documents")
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX34: the first of four reasons that a text was not taken apart."""
    return table(spark, sf_dir, "documents").select("doc_id", reason(F.col("text")).alias("reason"))


@query(f"""WITH r AS (SELECT source, lang, {REASON} AS reason FROM documents) SELECT source, COUNT(*) AS texts, COUNT(*) FILTER (WHERE reason IS NULL) AS parsed, COUNT(*) FILTER (WHERE reason = 'empty') AS empty, COUNT(*) FILTER (WHERE reason = 'symbols') AS symbols, COUNT(*) FILTER (WHERE reason = 'no sentences') AS no_sentences, COUNT(DISTINCT lang) AS languages FROM r GROUP BY 1""")
def parsing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24: how much of each source was parsed, and why the rest was not."""
    d = table(spark, sf_dir, "documents").select("source", "lang", reason(F.col("text")).alias("reason"))
    kinds = [F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r.replace(" ", "_")) for r in ("empty", "symbols", "no sentences")]
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("reason").isNull()).alias("parsed"), *kinds, F.countDistinct("lang").alias("languages"))


@query("""WITH b AS (SELECT doc_id, CASE WHEN strpos(text, 'token') > 0 THEN substr(text, strpos(text, 'token') + 5, 600) END AS body FROM documents) SELECT doc_id, md5(regexp_extract(body, '(?s)^(.*?)(?:password|Licensed|Released|\\z)', 1)) AS section FROM b""")
def section_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX22: a section runs from its heading to the next known one, 600 characters at most; a missing one is null, not empty."""
    at = F.instr("text", "token")
    body = F.when(at > 0, F.substring("text", at + 5, F.lit(600)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_extract(body, "(?s)^(.*?)(?:password|Licensed|Released|\\z)", 1)).alias("section"))


@query(f"""WITH {LINKS}, v AS (SELECT chain, rank, amount, party FROM links) SELECT chain, string_agg(CAST(party AS VARCHAR), ',' ORDER BY rank DESC, amount DESC, party) AS parties, COUNT(*) AS links FROM v GROUP BY 1""")
def links_of_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG26, PG34: links grouped by vote, in the fixed order of certainty, then by amount."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), (-F.col("amount")).alias("a"), "party")))
    return links(spark, sf_dir).groupBy("chain").agg(F.array_join(F.transform(order, lambda x: x["party"].cast("string")), ",").alias("parties"), F.count(F.lit(1)).alias("links"))


@query(f"""WITH {CONTRACTS}, k AS (SELECT *, CASE WHEN direction = 'undetermined' THEN 'estimate' ELSE 'fact' END AS certainty, party_name || ' ' || repeat('x', CAST(party % 200 AS INTEGER)) AS title FROM contracts) SELECT id, substr(title, 1, 160) AS title, length(title) > 160 AS cut, CASE WHEN certainty <> 'fact' THEN 'undisclosed direction' END AS reason FROM k""")
def short_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ04: items of an axis: titles cut to 160 characters, a reason only for what is no fact."""
    title = F.concat(F.col("party_name"), F.lit(" "), F.repeat(F.lit("x"), (F.col("party") % 200).cast("int")))
    return contracts(spark, sf_dir).withColumn("title", title).select("id", F.substring("title", 1, 160).alias("short"), (F.length("title") > 160).alias("cut"), F.when(F.col("direction") == "undetermined", "undisclosed direction").alias("reason")).withColumnRenamed("short", "title")


@query(f"""WITH {CANDIDATES}, b AS (SELECT p_id, MAX({{'s': score, 'g': -abs(gap), 'c': -c_id, 'gap': gap, 'h': hard}}) AS x FROM cand GROUP BY 1)
SELECT direction || '-' || year(signed) || '-' || p_id || '__' || -x.c AS id, x.s AS score, concat_ws('; ', 'same party', x.gap || ' days', CASE WHEN x.h THEN 'amount agrees' END, CASE WHEN amount IS NULL THEN 'amount unknown' END) AS reasons
FROM b JOIN (SELECT DISTINCT id, direction, signed, amount FROM contracts) ON id = p_id""")
def pair_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ05: the shape of a matched pair: an id of organ, year, point and contract, and the evidence as one text; each point's best contract."""
    found = candidates(spark, sf_dir).select("p_id", F.struct(F.col("score").alias("s"), (-F.abs("gap")).alias("g"), (-F.col("c_id")).alias("c"), "gap", "hard").alias("x"))
    best = found.groupBy("p_id").agg(F.max("x").alias("x"))
    rows = best.join(contracts(spark, sf_dir).select(F.col("id").alias("p_id"), "direction", "signed", "amount").distinct(), "p_id")
    reasons = F.concat_ws("; ", F.lit("same party"), F.concat(F.col("x.gap").cast("string"), F.lit(" days")), F.when(F.col("x.hard"), "amount agrees"), F.when(F.col("amount").isNull(), "amount unknown"))
    key = F.concat("direction", F.lit("-"), F.year("signed").cast("string"), F.lit("-"), F.col("p_id").cast("string"), F.lit("__"), (-F.col("x.c")).cast("string"))
    return rows.select(key.alias("id"), F.col("x.s").alias("score"), reasons.alias("reasons"))


@query(f"""WITH {CONTRACTS} SELECT party, COUNT(*) AS contracts, COUNT(*) FILTER (WHERE amount IS NULL) AS undisclosed, CAST(coalesce(SUM(amount), 0) AS DOUBLE) AS total FROM contracts WHERE party % 25 = owner GROUP BY 1""")
def holding_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG17: contracts of the holding by counterparty; an undisclosed amount adds nothing and is counted."""
    c = contracts(spark, sf_dir).filter(F.col("party") % 25 == F.col("owner"))
    return c.groupBy("party").agg(F.count(F.lit(1)).alias("contracts"), F.count_if(F.col("amount").isNull()).alias("undisclosed"), F.coalesce(total(F.col("amount")), F.lit(0.0)).alias("total"))


@query("""WITH v AS (SELECT conv_id, 'Record of ' || strftime(DATE '2001-01-01' + CAST(conv_id % 400 AS INTEGER), '%d.%m.%Y') AS title FROM (SELECT DISTINCT conv_id FROM conversations)), d AS (SELECT conv_id, try_strptime(regexp_extract(title, '[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}'), '%d.%m.%Y')::DATE AS day FROM v)
SELECT conv_id, o_orderkey AS meeting FROM d JOIN orders ON CAST(o_orderdate AS DATE) = day AND o_orderpriority = '1-URGENT'""")
def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG33: recordings joined to meetings by the date in their titles."""
    from civicrill.functions.dates import local_date

    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    titled = ids.select("conv_id", F.concat(F.lit("Record of "), F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("conv_id") % 400).cast("int")), "dd.MM.yyyy")).alias("title"))
    m = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("meeting"))
    return titled.select("conv_id", local_date(F.col("title")).alias("day")).join(m, "day").select("conv_id", "meeting")


@query(f"""WITH {LINKS}, k AS (SELECT chain AS a, party AS b, MIN(rank) AS rank FROM links GROUP BY 1, 2) SELECT 'code list' AS rule, COUNT(*) AS checked, COUNT(*) FILTER (WHERE rank NOT IN (0, 1, 2)) AS failures FROM k
UNION ALL SELECT 'gap', COUNT(*), COUNT(*) FILTER (WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'identity', COUNT(*), COUNT(*) FILTER (WHERE c_custkey IS NULL) FROM orders LEFT JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'stale sample', COUNT(*), COUNT(*) FILTER (WHERE share > 0.2) FROM (SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') / COUNT(*) AS share FROM orders GROUP BY 1)""")
def chain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ09: rules of published chains: known certainty, no effect before its cause, a signal of identity, no stale sample."""
    k = links(spark, sf_dir).groupBy("chain", "party").agg(F.min("rank").alias("rank"))
    orders = table(spark, sf_dir, "orders")
    both = table(spark, sf_dir, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    known = orders.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    stale = orders.groupBy("o_orderpriority").agg((F.count_if(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")) / F.count(F.lit(1))).alias("share"))
    rule = lambda df, name, bad: df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("checked"), F.count_if(bad).alias("failures"))
    out = rule(k, "code list", ~F.col("rank").isin(0, 1, 2))
    for other in (rule(both, "gap", F.to_date("l_shipdate") < F.to_date("o_orderdate")), rule(known, "identity", F.col("c_custkey").isNull()), rule(stale, "stale sample", F.col("share") > 0.2)):
        out = out.unionByName(other)
    return out


@query(f"""WITH {LINKS}, c AS (SELECT chain, MAX(amount) AS most, SUM(amount) AS total FROM links GROUP BY 1), u AS (SELECT SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'))
SELECT COUNT(*) AS chains, COUNT(*) FILTER (WHERE most > total) AS failures, CAST(MAX(s) AS DOUBLE) AS unmatched FROM c, u""")
def volume_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ11: the largest part never exceeds the sum; the volume without a match is told beside it."""
    c = links(spark, sf_dir).groupBy("chain").agg(F.max("amount").alias("most"), F.sum("amount").alias("total"))
    matched = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rest = table(spark, sf_dir, "orders").join(matched, "o_orderkey", "left_anti").agg(total(F.col("o_totalprice")).alias("unmatched"))  # one row
    return c.agg(F.count(F.lit(1)).alias("chains"), F.count_if(F.col("most") > F.col("total")).alias("failures")).crossJoin(F.broadcast(rest))


@query("""WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type AS section, COUNT(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT DISTINCT event_type AS section FROM events) SELECT s.section, CAST(m.week AS VARCHAR) AS week, coalesce(n, 0) AS items, CASE WHEN n IS NULL THEN 'missing' WHEN n < 100 THEN 'thin' ELSE 'ok' END AS state FROM s CROSS JOIN (SELECT MAX(week) AS week FROM w) m LEFT JOIN w ON w.week = m.week AND w.section = s.section""")
def issue_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ06: the latest issue has every section that was ever published, none missing or thin."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), F.col("event_type").alias("section")).agg(F.count(F.lit(1)).alias("n"))
    last = e.agg(F.max("week").alias("week"))  # one row
    axis = e.select("section").distinct().crossJoin(F.broadcast(last))
    n = F.col("n")
    return axis.join(e, ["week", "section"], "left").select("section", F.col("week").cast("string").alias("week"), F.coalesce(n, F.lit(0).cast("long")).alias("items"), F.when(n.isNull(), "missing").when(n < 100, "thin").otherwise("ok").alias("state"))


@query("""WITH e AS (SELECT user_id AS source, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS k FROM events), r AS (SELECT source, failed, n - k AS run, COUNT(*) AS length FROM e GROUP BY 1, 2, 3)
SELECT source, CAST(SUM(length) AS BIGINT) AS calls, CAST(coalesce(SUM(length) FILTER (WHERE failed), 0) AS BIGINT) AS failures, coalesce(MAX(length) FILTER (WHERE failed), 0) AS longest_run, CASE WHEN coalesce(MAX(length) FILTER (WHERE failed), 0) >= 25 THEN 'stopped' WHEN coalesce(SUM(length) FILTER (WHERE failed), 0) > 0.1 * SUM(length) THEN 'error' ELSE 'ok' END AS state FROM r GROUP BY 1""")
def failure_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ14: 25 failures in a row stop a source, more than a tenth of its calls is an error."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    run = e.withColumn("good", F.count_if(~F.col("failed")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("source", "good").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("bad"))
    t = run.groupBy("source").agg(F.sum("n").alias("calls"), F.sum("bad").alias("failures"), F.max("bad").alias("longest_run"))
    return t.withColumn("state", F.when(F.col("longest_run") >= 25, "stopped").when(F.col("failures") > 0.1 * F.col("calls"), "error").otherwise("ok"))


@query("""WITH k AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) SELECT conv_id, arg_min(role, (-length(text), turn)) AS role, MAX(length(text)) AS chars, arg_min(turn, (-length(text), turn)) AS turn FROM k GROUP BY 1""")
def best_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST05: of several descriptions the longest one, then the one that comes first."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    return first_by(c, ["conv_id"], -F.col("chars"), F.col("turn")).select("conv_id", "role", "chars", "turn")


@query("""WITH u AS (SELECT o_orderkey AS id, o_custkey AS grp, CASE WHEN o_orderkey % 3 = 0 THEN 'Approved. ' ELSE '' END || o_orderpriority AS text, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS flag FROM orders), k AS (SELECT *, regexp_replace(text, '^Approved\\. ', '') AS core FROM u)
SELECT grp, core AS text, COUNT(*) AS merged, MIN(flag) AS flag, MIN(id) AS first_id FROM k GROUP BY 1, 2""")
def suffix_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST06: a text that is another one after a status sentence goes, its known flags stay. Texts meet by what follows the sentence, not in pairs."""
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Approved. ").otherwise(""), "o_orderpriority")
    u = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), F.regexp_replace(text, "^Approved\\. ", "").alias("text"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("flag"))
    return u.groupBy("grp", "text").agg(F.count(F.lit(1)).alias("merged"), F.min("flag").alias("flag"), F.min("id").alias("first_id"))
