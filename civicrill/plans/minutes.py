"""Minutes of committees: written from the lines of an order, taken apart again, and held against the rows that they were written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicrill.operators.minutes import agenda, header, resolutions
from civicrill.plans.persons import PERSONS, persons
from civicrill.plans.registry import query
from civicrill.sources.tables import table

#: Lists of the header by the flag of a line; the names of lines with a quantity that this divides run together.
LISTS = {"N": "Přítomni", "R": "Omluveni", "A": "Nepřítomni"}
RUN_TOGETHER = 25


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, text: a point for each line of an order in the order of lines, of six kinds by the part; a line without a quantity or number has no poll."""
    who = persons(spark, sf_dir).select("person", F.concat("given", F.lit(" "), "surname").alias("name"))
    li = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"), "l_returnflag")
    lines = li.join(who, li["l_partkey"] == who["person"])
    each = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "q", F.col("l_returnflag").alias("flag"), "name")))
    kept = lines.groupBy(F.col("l_orderkey").alias("meeting")).agg(each.alias("x"))

    def listed(flag: str, heading: str) -> Column:
        entries = F.transform(F.filter("x", lambda r: r["flag"] == flag), lambda r: F.when(r["q"] % RUN_TOGETHER == 0, F.concat_ws(" ", r["name"], r["name"])).otherwise(r["name"]))
        return F.when(F.size(entries) > 0, F.concat(F.lit(f"{heading}: "), F.array_join(entries, ", ")))

    def point(r: Column, i: Column) -> Column:
        what, kind = F.concat(F.lit("záměr "), _s(r["l_partkey"])), r["l_partkey"] % 6
        poll = F.coalesce(F.concat(F.lit("\nHlasování: pro "), _s(r["q"]), F.lit(", proti "), _s(r["l_linenumber"]), F.lit(", zdržel se 0")), F.lit(""))
        body = (
            F.when(kind == 0, F.concat(F.lit("\nDiskuse.\nUsnesení č. 1: Komise doporučuje "), what, F.lit("."), poll, F.lit("\nUsnesení bylo přijato.")))
            .when(kind == 1, F.concat(F.lit("\nUsnesení:\nKomise nedoporučuje\n"), what, F.lit("."), poll))
            .when(kind == 2, F.concat(F.lit("\nNávrh nebyl přijat.\nUsnesení: Komise žádá o "), what, F.lit(".\n\nKomise bere na vědomí zprávu.")))
            .when(kind == 3, F.concat(F.lit("\nPan starosta uvedl bod. Komise souhlasí s tím, že trvá "), what, F.lit(". Další věta.")))
            .when(kind == 4, F.concat(F.lit("\nUsnesení: "), what, F.lit(" se odkládá *****\nKomise navrhuje jiný bod."), poll))
            .otherwise(F.concat(F.lit("\nMěstská komise doporučuje "), what, F.lit(".")))
        )
        return F.concat(_s(i + 1), F.lit(". Bod "), _s(r["l_partkey"]), body)

    head = F.concat_ws("\n", F.concat(F.lit("Zápis "), _s("meeting")), *[listed(f, h) for f, h in LISTS.items()], F.lit("Zapsala: Jana Nová"), F.lit("5. 1. 2026"))
    return kept.select("meeting", F.concat_ws("\n", head, F.transform("x", point)).alias("text"))


_ROWS = f"""{PERSONS}, x AS (SELECT l_orderkey AS meeting, l_linenumber AS line, l_partkey AS part, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS flag, given || ' ' || surname AS name,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, l_partkey, CAST(l_quantity AS BIGINT) NULLS FIRST, l_returnflag NULLS FIRST, given || ' ' || surname NULLS FIRST) AS point FROM lineitem JOIN persons ON person = l_partkey WHERE l_orderkey IS NOT NULL)"""
_NAMES = "string_agg(name, ', ' ORDER BY point) FILTER (WHERE flag = '{0}' AND coalesce(q % 25 <> 0, true))"


@query(f"""WITH {_ROWS}, f AS (SELECT meeting, part, MIN(point) AS point FROM x GROUP BY 1, 2), a AS (SELECT meeting, string_agg('Bod ' || part, '; ' ORDER BY point) AS agenda FROM f GROUP BY 1)
SELECT meeting, {_NAMES.format('N')} AS present, {_NAMES.format('R')} AS excused, {_NAMES.format('A')} AS absent, CAST(NULL AS VARCHAR) AS guests, 'Jana Nová' AS recorder, coalesce(bool_or(q % 25 = 0 AND flag IN ('N', 'R', 'A') AND name IS NOT NULL), false) AS damaged, MIN(agenda) AS agenda FROM x JOIN a USING (meeting) GROUP BY 1""")
def minutes_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX22: who was present, excused and absent, the recorder and the titles of the agenda; a list that the minutes lack is null."""
    h = minutes(spark, sf_dir).select("meeting", header(F.col("text")).alias("h"), agenda(F.col("text")).alias("a"))
    lists = [F.array_join(f"h.{name}", ", ").alias(name) for name in ("present", "excused", "absent", "guests")]
    return h.select("meeting", *lists, "h.recorder", "h.damaged", F.array_join("a", "; ").alias("agenda"))


@query(f"""WITH {_ROWS} SELECT meeting, point, CASE WHEN part % 6 = 3 THEN 'sentence' ELSE 'block' END AS source,
 CASE part % 6 WHEN 0 THEN 'Komise doporučuje záměr ' || part || '.' WHEN 1 THEN 'Komise nedoporučuje záměr ' || part || '.' WHEN 2 THEN 'Komise žádá o záměr ' || part || '.' WHEN 3 THEN 'Komise souhlasí s tím, že trvá záměr ' || part || '.' ELSE 'záměr ' || part || ' se odkládá' END AS text,
 CASE part % 6 WHEN 0 THEN 'recommends' WHEN 1 THEN 'advises against' WHEN 2 THEN 'asks' WHEN 3 THEN 'agrees' END AS direction, CASE part % 6 WHEN 0 THEN true WHEN 2 THEN false END AS adopted,
 CASE WHEN part % 6 IN (0, 1, 4) AND q IS NOT NULL AND line IS NOT NULL THEN q END AS in_favour, CASE WHEN part % 6 IN (0, 1, 4) AND q IS NOT NULL AND line IS NOT NULL THEN line END AS against, CASE WHEN part % 6 IN (0, 1, 4) AND q IS NOT NULL AND line IS NOT NULL THEN 0 END AS abstained FROM x WHERE part % 6 < 5""")
def minutes_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX22, AG23: resolutions with what the body wants, its poll, and whether the minutes say that it was adopted."""
    r = minutes(spark, sf_dir).select("meeting", F.explode(resolutions(F.col("text"))).alias("r"))
    return r.select("meeting", "r.point", "r.source", "r.text", "r.direction", "r.adopted", "r.in_favour", "r.against", "r.abstained")
