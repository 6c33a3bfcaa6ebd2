"""Persons named in texts and persons who speak. Each part stands for a person; texts are built of the names of an order's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicrill.operators.collation import placed
from civicrill.operators.mentions import HARD, MOST, SOFT, mentions, speakers
from civicrill.plans.registry import query
from civicrill.sources.tables import table

#: Syllables that make a surname of a key.
SYLLABLES = ("bek", "cil", "dan", "fer", "gor", "hak", "jana", "kol", "lub", "mar", "nov", "pet", "rosa", "sed", "tom", "vit")
ENDINGS = ("", "a", "ovi", "em", "y", "u")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person, given, surname; some surnames belong to several persons."""
    k = F.col("p_partkey")
    syllable = lambda n: F.get(F.array(*[F.lit(s) for s in SYLLABLES]), n.cast("int"))
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    return table(spark, sf_dir, "part").select(k.alias("person"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("given"), F.initcap(F.concat(noun, syllable(F.floor(k / 16) % 16), syllable(k % 16))).alias("surname"))


def _inflected(name: Column, case: Column) -> Column:
    return F.concat(name, F.get(F.array(*[F.lit(e) for e in ENDINGS]), case.cast("int")))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _forms(name: str, side: int) -> str:
    soft, hard = (_list(e[side] for e in ends) for ends in (SOFT, HARD))
    return f"CASE WHEN lower({name}) LIKE '%a' THEN list_transform({soft}, lambda e: left(lower({name}), -1) || e) ELSE list_transform({hard}, lambda e: lower({name}) || e) END"


PERSONS = f"""n AS (SELECT p_partkey AS person, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) || ({_list(SYLLABLES)})[p_partkey // 16 % 16 + 1] || ({_list(SYLLABLES)})[p_partkey % 16 + 1] AS b FROM part),
persons AS (SELECT person, upper(a[1]) || a[2:] AS given, upper(b[1]) || b[2:] AS surname FROM n)"""


@query(f"""WITH {PERSONS}, x AS (SELECT l_orderkey, l_linenumber, given || ({_list(ENDINGS)})[(l_linenumber + l_orderkey) % {len(ENDINGS)} + 1] AS g, surname || ({_list(ENDINGS)})[(l_linenumber + l_orderkey) % {len(ENDINGS)} + 1] AS s, l_partkey FROM lineitem JOIN persons ON person = l_partkey),
texts AS (SELECT l_orderkey AS id, string_agg('Bod ' || l_linenumber || ' předkládá ' || g || ' ' || s || CASE WHEN l_partkey % 3 = 0 THEN ', hovoří ' || g || ' ' || s || '.' ELSE '.' END, ' ' ORDER BY l_linenumber, l_partkey, g, s) AS t FROM x WHERE l_orderkey IS NOT NULL GROUP BY 1),
w AS (SELECT id, list_filter(string_split_regex(t, '[^\\p{{L}}]+'), lambda x: x <> '') AS ws FROM texts),
p AS (SELECT id, unnest(ws[1:len(ws) - 1]) AS a, unnest(ws[2:]) AS b FROM w), c AS (SELECT id, lower(a) AS a, lower(b) AS b FROM p WHERE regexp_matches(a, '^\\p{{Lu}}') AND regexp_matches(b, '^\\p{{Lu}}')),
f AS (SELECT person, unnest({_forms('given', 0)}) AS a, unnest({_forms('surname', 1)}) AS b FROM persons), i AS (SELECT a, b, MIN(person) AS person FROM f WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2 HAVING MIN(person) = MAX(person)),
m AS (SELECT id, person, COUNT(*) AS times FROM c JOIN i USING (a, b) GROUP BY 1, 2)
SELECT * FROM (SELECT id, person, times, row_number() OVER (PARTITION BY id ORDER BY times DESC, person) AS rank FROM m) WHERE rank <= {MOST}""")
def person_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX20: persons named in a text in any case, by the index of name forms."""
    who = persons(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null").select("l_orderkey", "l_linenumber", "l_partkey")
    case = (F.col("l_linenumber") + F.col("l_orderkey")) % len(ENDINGS)
    name = F.concat_ws(" ", _inflected(F.col("given"), case), _inflected(F.col("surname"), case))
    line = F.concat(F.lit("Bod "), "l_linenumber", F.lit(" předkládá "), name, F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(", hovoří "), name, F.lit("."))).otherwise("."))
    lines = li.join(who, li["l_partkey"] == who["person"]).select("l_orderkey", F.struct("l_linenumber", "l_partkey", line.alias("line")).alias("x"))
    texts = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), " ").alias("text"))
    return mentions(texts, who, "id", "person")


@query(f"""WITH {PERSONS}, s AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN CASE turn % 2 WHEN 0 THEN 'Slovo má pan zastupitel ' || surname || '. ' ELSE 'Prosím pana ' || surname || CASE WHEN surname LIKE '%a' THEN '' ELSE 'a' END || '. ' END ELSE '' END || c.text AS text
  FROM conversations c LEFT JOIN persons ON person = (conv_id * 13 + turn * 7) % 200 WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
k AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '(?:[Ss]lovo m[áa]|[Pp]rosím|[Dd]ěkuji|[Hh]lásí se|[Vv]ystoupí)(?:\\s+[Pp]an[aíiu]?)?(?:\\s+(?:zastupitel|starost|radn|doktor)\\p{{L}}*)?\\s+(\\p{{Lu}}\\p{{L}}{{2,}})', 1), lambda x: lower(x)) AS ks FROM s),
u AS (SELECT conv_id, turn, unnest(ks) AS surname, unnest(range(len(ks))) AS no FROM k), f AS (SELECT person, unnest({_forms('surname', 1)}) AS surname FROM persons),
i AS (SELECT surname, MIN(person) AS person FROM f WHERE surname IS NOT NULL GROUP BY 1 HAVING MIN(person) = MAX(person)), l AS (SELECT conv_id, turn, arg_max(person, no) AS called FROM u JOIN i USING (surname) GROUP BY 1, 2)
SELECT conv_id, turn, last_value(called IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS person FROM k LEFT JOIN l USING (conv_id, turn)""")
def speaker_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX35: the speaker of each turn, by the last call that names one person."""
    who = persons(spark, sf_dir)
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    k = c.join(who, who["person"] == (F.col("conv_id") * 13 + F.col("turn") * 7) % 200, "left")
    first = F.concat(F.lit("Slovo má pan zastupitel "), "surname", F.lit(". "))
    second = F.concat(F.lit("Prosím pana "), "surname", F.when(F.col("surname").endswith("a"), "").otherwise("a"), F.lit(". "))
    call = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.when(F.col("turn") % 2 == 0, first).otherwise(second)).otherwise("")
    return speakers(k.select("conv_id", "turn", F.concat(call, "text").alias("text")), who, "conv_id", "turn", "person")


#: Beginnings that tell the rules of the language apart, in its order.
BEGINNINGS = ("Cibule", "Čáp", "Had", "Hůl", "Chata", "Ibis", "Íránec", "Rak", "Řeka", "Sýr", "Šíp", "Zub", "Žák")


@query(f"""WITH c AS (SELECT c_custkey, c_custkey % {len(BEGINNINGS)} AS b, c_custkey // {len(BEGINNINGS)} % 50 AS n FROM customer WHERE c_custkey IS NOT NULL)
SELECT c_custkey AS id, ({_list(BEGINNINGS)})[b + 1] || ' ' || lpad(CAST(n AS VARCHAR), 2, '0') AS name, row_number() OVER (ORDER BY b, n, c_custkey) AS place FROM c""")
def czech_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO03: places of names in Czech order. The names of a partition are counted first, so no task holds all of them."""
    k, each = F.col("c_custkey"), len(BEGINNINGS)
    beginning = F.get(F.array(*[F.lit(b) for b in BEGINNINGS]), (k % each).cast("int"))
    name = F.concat_ws(" ", beginning, F.lpad((F.floor(k / each) % 50).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "customer").filter("c_custkey is not null").select(k.alias("id"), name.alias("name"))
    return placed(rows, "name", "id")
