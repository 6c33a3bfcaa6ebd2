"""What texts state: amendments, numbers, sizes, dates, names, departments. Texts are built from the tables, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicrill.functions import dates as D
from civicrill.functions import text as T
from civicrill.operators.naming import longest_named
from civicrill.plans.registry import query
from civicrill.sources.tables import table

PLAIN = "lower(strip_accents(text))"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _kinds(key: Column, *texts: Column) -> Column:
    """The text of a row by the remainder of its key."""
    out = F.when(key % len(texts) == 0, texts[0])
    for i, t in enumerate(texts[1:], 1):
        out = out.when(key % len(texts) == i, t)
    return out


def _s(c: Column) -> Column:
    return c.cast("string")


@query(f"""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Dodatek č. ' || o_custkey % 30 || ' ke smlouvě' WHEN 1 THEN 'k dodatku č.' || o_custkey % 30 WHEN 2 THEN 'Dodatekč.' || o_custkey % 30 WHEN 3 THEN 'Amendment no. ' || o_custkey % 30 ELSE 'smlouva č. ' || o_custkey END AS text FROM orders)
SELECT id, regexp_matches({PLAIN}, '\\b(?:dodatk(?:u|y|em)|dodatek|amendment)') AS amendment, try_cast(nullif(regexp_extract({PLAIN}, '\\b(?:dodatk(?:u|y|em)|dodatek|amendment) ?(?:c\\.?|no\\.?)? ?([0-9]{{1,4}})', 1), '') AS INTEGER) AS number FROM t""")
def amendment_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX12: whether a text names an amendment, and its number, in several cases and spellings."""
    n, k = _s(F.col("o_custkey") % 30), F.col("o_orderkey")
    text = _kinds(k, F.concat(F.lit("Dodatek č. "), n, F.lit(" ke smlouvě")), F.concat(F.lit("k dodatku č."), n), F.concat(F.lit("Dodatekč."), n), F.concat(F.lit("Amendment no. "), n), F.concat(F.lit("smlouva č. "), _s(F.col("o_custkey"))))
    return _orders(spark, sf_dir).select(k.alias("id"), text.alias("text")).select("id", T.is_amendment(F.col("text")).alias("amendment"), T.amendment_number(F.col("text")).alias("number"))


@query("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN replace(CAST(CAST(o_custkey * 1.25 AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || '-' WHEN 1 THEN '   ' WHEN 2 THEN CAST(o_custkey AS VARCHAR) ELSE 'n/a' END AS text FROM orders)
SELECT id, CASE WHEN trim(text) = '' THEN NULL WHEN text LIKE '%-' THEN -try_cast(replace(rtrim(text, '-'), ',', '.') AS DOUBLE) ELSE try_cast(replace(text, ',', '.') AS DOUBLE) END AS value, lpad(ltrim(CAST(id AS VARCHAR), '0'), 8, '0') AS padded FROM t""")
def signed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX15: numbers with a trailing minus; blank and unreadable ones are unknown; ids padded to eight digits."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = _kinds(k, F.concat(F.replace(_s((c * F.lit(1.25)).cast("decimal(18,2)")), F.lit("."), F.lit(",")), F.lit("-")), F.lit("   "), _s(c), F.lit("n/a"))
    return _orders(spark, sf_dir).select(k.alias("id"), text.alias("text")).select("id", T.signed_number(F.col("text")).alias("value"), F.lpad(F.ltrim(_s(F.col("id")), F.lit("0")), 8, "0").alias("padded"))


@query("""WITH c AS (SELECT o_custkey AS party, COUNT(*) AS n FROM orders GROUP BY 1) SELECT party, n || ' ' || CASE WHEN n = 1 THEN 'smlouva' WHEN n BETWEEN 2 AND 4 THEN 'smlouvy' ELSE 'smluv' END AS shown, CASE WHEN n * 1250000 >= 10000000 THEN floor(n * 1.25 + 0.5) || ' mil.' ELSE n * 1250 || ' tis.' END AS money FROM c""")
def plural_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX36: counts in the grammatical form of their number, money in thousands or millions."""
    c = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("party")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    money = F.when(n * 1250000 >= 10000000, F.concat(_s(F.floor(n * F.lit(1.25) + 0.5)), F.lit(" mil."))).otherwise(F.concat(_s(n * 1250), F.lit(" tis.")))
    return c.select("party", F.concat_ws(" ", _s(n), T.plural(n, "smlouva", "smlouvy", "smluv")).alias("shown"), money.alias("money"))


@query("""WITH t AS (SELECT p_partkey AS id, p_size || ', 08-' || (8 + p_size % 30) || ' a 0' || p_size % 9 || '/3' AS text FROM part), x AS (SELECT id, regexp_extract_all(text, '[0-9]{1,4}(?:-[0-9]{1,4})?') AS parts FROM t),
e AS (SELECT id, i, CAST(split_part(parts[i], '-', 1) AS INTEGER) AS a, CAST(nullif(split_part(parts[i], '-', 2), '') AS INTEGER) AS b FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS i FROM x))
SELECT id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i, v) AS numbers FROM (SELECT id, i, unnest(CASE WHEN b IS NULL THEN [a] WHEN b >= a AND b - a <= 20 THEN range(a, b + 1) ELSE [] END) AS v FROM e) GROUP BY 1""")
def change_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX37: numbers and short spans of numbers in a text, written out."""
    size = F.col("p_size")
    text = F.concat(_s(size), F.lit(", 08-"), _s(size % 30 + 8), F.lit(" a 0"), _s(size % 9), F.lit("/3"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.expand_numbers(text).cast("array<string>"), ",").alias("numbers"))


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 3 THEN 'unknown' ELSE 'PDF, ' || p_size || ',' || (10 + p_size % 80) || ' ' || ['k', 'M', 'G'][1 + p_partkey % 4] || 'B' END AS text FROM part), x AS (SELECT id, try_cast(replace(regexp_extract(text, '([0-9]+(?:[.,][0-9]+)?) ?([kMG]?)B', 1), ',', '.') AS DOUBLE) AS n, regexp_extract(text, '([0-9]+(?:[.,][0-9]+)?) ?([kMG]?)B', 2) AS u FROM t)
SELECT id, CAST(trunc(n * CASE u WHEN 'k' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'G' THEN 1e9 ELSE 1 END) AS BIGINT) AS bytes FROM x""")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX39: sizes of files as their pages state them, in decimal units; unreadable ones are unknown."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 4 == 3, "unknown").otherwise(F.concat(F.lit("PDF, "), _s(size), F.lit(","), _s(size % 80 + 10), F.lit(" "), F.element_at(F.array(*map(F.lit, ("k", "M", "G", "-"))), (k % 4 + 1).cast("int")), F.lit("B")))
    return table(spark, sf_dir, "part").select(k.alias("id"), T.file_bytes(text).alias("bytes"))


PARTIES = {"BUILDING": "Builders", "MACHINERY": "Makers"}


@query("""SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Builders' WHEN 'MACHINERY' THEN 'Makers' ELSE c_mktsegment END AS party FROM customer""")
def party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX40: names of parties by a map; a name that the map does not know stays."""
    known = F.create_map(*[F.lit(x) for pair in PARTIES.items() for x in pair])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.coalesce(known[F.col("c_mktsegment")], F.col("c_mktsegment")).alias("party"))


#: The day is off by up to three, so some dates do not exist.
DATED = "'Jednání dne ' || (day(o_orderdate) + o_orderkey % 4) || CASE WHEN o_orderkey % 2 = 0 THEN '. ' ELSE '.' END || month(o_orderdate) || '. ' || year(o_orderdate) || ' v radnici, příště 1. 2. 2003'"


@query(f"""WITH t AS (SELECT o_orderkey AS id, {DATED} AS text FROM orders), g AS (SELECT id, regexp_extract_all(text, '\\b([0-9]{{1,2}})\\. ?([0-9]{{1,2}})\\. ?([0-9]{{4}})\\b', 1) AS d, regexp_extract_all(text, '\\b([0-9]{{1,2}})\\. ?([0-9]{{1,2}})\\. ?([0-9]{{4}})\\b', 2) AS m, regexp_extract_all(text, '\\b([0-9]{{1,2}})\\. ?([0-9]{{1,2}})\\. ?([0-9]{{4}})\\b', 3) AS y FROM t),
e AS (SELECT id, list_transform(range(1, len(d) + 1), lambda i: try_cast(y[i] || '-' || lpad(m[i], 2, '0') || '-' || lpad(d[i], 2, '0') AS DATE)) AS days FROM g) SELECT id, CAST(days[1] AS VARCHAR) AS first_date, array_to_string(list_transform(list_filter(days, lambda x: x IS NOT NULL), lambda x: CAST(x AS VARCHAR)), ',') AS dates FROM e""")
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT01: the first date of a text, null if there is no such day, and all that exist."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.concat(F.lit("Jednání dne "), _s(F.dayofmonth(d) + k % 4), F.when(k % 2 == 0, ". ").otherwise("."), _s(F.month(d)), F.lit(". "), _s(F.year(d)), F.lit(" v radnici, příště 1. 2. 2003"))
    return _orders(spark, sf_dir).select(k.alias("id"), text.alias("text")).select("id", _s(D.local_date(F.col("text"))).alias("first_date"), F.array_join(F.transform(D.local_dates(F.col("text")), lambda x: x.cast("string")), ",").alias("dates"))


@query("""WITH g AS (SELECT l_orderkey AS id, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS gap FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT CASE WHEN gap BETWEEN 0 AND 120 THEN 26 WHEN gap BETWEEN 0 AND 365 THEN 16 WHEN gap BETWEEN 0 AND 730 THEN 6 ELSE 0 END AS points, COUNT(*) AS pairs, MIN(gap) AS least, MAX(gap) AS most FROM g GROUP BY 1""")
def day_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT03: points for closeness in days."""
    li = table(spark, sf_dir, "lineitem").join(_orders(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
    g = li.select(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long").alias("gap"))
    return g.groupBy(D.days_class(F.col("gap")).alias("points")).agg(F.count(F.lit(1)).alias("pairs"), F.min("gap").alias("least"), F.max("gap").alias("most"))


@query("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN strftime(o_orderdate, '%Y%m') ELSE strftime(o_orderdate, '%Y%m') || lpad(CAST(day(o_orderdate) + o_orderkey % 3 AS VARCHAR), 2, '0') END AS code, (epoch_ms(o_orderdate) - 1400000000000) AS ms FROM orders)
SELECT id, CASE WHEN regexp_full_match(code, '[0-9]{8}') THEN CAST(try_cast(substr(code, 1, 4) || '-' || substr(code, 5, 2) || '-' || substr(code, 7, 2) AS DATE) AS VARCHAR) END AS day, year(make_timestamp(ms * 1000)) AS year FROM t""")
def compact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT07: yyyymmdd as a date, else unknown; milliseconds since 1970, also before it, as a year."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    month = F.date_format(d, "yyyyMM")
    code = F.when(k % 4 == 3, month).otherwise(F.concat(month, F.lpad(_s(F.dayofmonth(d) + k % 3), 2, "0")))
    ms = F.unix_millis(d.cast("timestamp")) - F.lit(1400000000000)
    return _orders(spark, sf_dir).select(k.alias("id"), _s(D.compact_date(code)).alias("day"), F.year(F.timestamp_millis(ms)).cast("long").alias("year"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name || ' (' || p_brand || ', ' || p_type || '), ' || p_type || ', Ing. ' || p_name AS text FROM part) SELECT id, array_to_string(list_transform(string_split(regexp_replace(text, '\\([^()]*\\)', '', 'g'), ','), lambda x: trim(x)), ';') AS names FROM t""")
def names_outside_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX21: a list of names split at commas outside brackets, what stands in brackets left out."""
    text = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(", "), "p_type", F.lit("), "), "p_type", F.lit(", Ing. "), "p_name")
    names = F.transform(F.split(text, ",(?![^()]*\\))"), lambda x: F.trim(F.regexp_replace(x, "\\([^()]*\\)", "")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(names, ";").alias("names"))


@query("""WITH f AS (SELECT regexp_replace(url, '^[a-z]+://([^/]*).*$', '\\1') AS host, page_id, length(html) AS size, CASE WHEN contains(url, 'ref=') THEN 2 WHEN contains(url, 'page=') THEN 0 ELSE 1 END AS class FROM pages) SELECT host, arg_min(page_id, (class, -size, page_id)) AS chosen, COUNT(*) AS candidates FROM f GROUP BY 1""")
def document_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX23: of several files the one whose name says minutes and no attachment, then the largest."""
    url = F.col("url")
    f = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://([^/]*).*$", "$1").alias("host"), "page_id", F.length("html").alias("size"), F.when(url.contains("ref="), 2).when(url.contains("page="), 0).otherwise(1).alias("class"))
    return f.groupBy("host").agg(F.min_by("page_id", F.struct("class", -F.col("size"), "page_id")).alias("chosen"), F.count(F.lit(1)).alias("candidates"))


def _inflected(words: Column) -> Column:
    """Longer words with an ending of another case."""
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.when(F.length(w) >= 5, F.concat(w, F.lit("ovi"))).otherwise(w)), " ")


_CASES = "array_to_string(list_transform(string_split({0}, ' '), lambda w: CASE WHEN length(w) >= 5 THEN w || 'ovi' ELSE w END), ' ')"


@query(f"""WITH p AS (SELECT p_partkey AS k, MIN(p_name) AS name FROM part GROUP BY 1), f AS (SELECT l_orderkey AS id, MIN(l_partkey) AS a, MAX(l_partkey) AS b FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1),
q AS (SELECT id, concat_ws(' ', 'Vyřizují odboru', {_CASES.format("x.name")}, 'a', {_CASES.format("y.name")}) AS text FROM f LEFT JOIN p x ON x.k = a LEFT JOIN p y ON y.k = b),
s AS (SELECT id, list_distinct(list_transform(string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w[1:5])) AS have FROM q),
n AS (SELECT name, list_distinct(list_transform(list_filter(string_split(name, ' '), lambda w: length(w) > 1), lambda w: w[1:5])) AS need FROM (SELECT DISTINCT 'odbor ' || p_name AS name FROM part WHERE p_name IS NOT NULL)),
h AS (SELECT id, unnest(have) AS w FROM s), k AS (SELECT name, len(need) AS size, unnest(need) AS w FROM n WHERE len(need) >= 2), c AS (SELECT id, name FROM h JOIN k USING (w) GROUP BY id, name, size HAVING COUNT(*) = size),
m AS (SELECT id, MAX({{'l': length(name), 'n': name}}).n AS department FROM c GROUP BY 1) SELECT s.id, department FROM s LEFT JOIN m ON m.id = s.id""")
def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX33: the longest name of a department all of whose words begin words of a sentence. Each name of a part names a department."""
    p = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.min("p_name").alias("name"))
    f = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    both = f.join(p.select(F.col("p_partkey").alias("a"), F.col("name").alias("x")), "a", "left").join(p.select(F.col("p_partkey").alias("b"), F.col("name").alias("y")), "b", "left")
    sentences = both.select("id", F.concat_ws(" ", F.lit("Vyřizují odboru"), _inflected(F.col("x")), F.lit("a"), _inflected(F.col("y"))).alias("text"))
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("odbor "), "p_name").alias("department"))
    return longest_named(sentences, names, "id", "text", "department")


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS name, string_split(p_name, ' ')[1] || 'ovi a ' || string_split(p_name, ' ')[2] || 'em' AS text FROM part), w AS (SELECT id, text, list_transform(string_split(name, ' '), lambda x: CASE WHEN length(x) >= 7 THEN x[1:length(x) - 2] WHEN length(x) >= 5 THEN x[1:length(x) - 1] ELSE x END) AS s FROM t)
SELECT id, regexp_matches(replace(text, ' a ', ' '), '\\b' || array_to_string(s, '[a-z0-9]*\\s+') || '[a-z0-9]*\\b') AS named, regexp_matches(text, '\\b' || array_to_string(s, '[a-z0-9]*\\s+') || '[a-z0-9]*\\b') AS apart FROM w""")
def inflected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX09: names found in other grammatical cases, by stems with free endings; other words between them are no match."""
    words = F.split("p_name", " ")
    text = F.concat(words[0], F.lit("ovi a "), words[1], F.lit("em"))
    pattern = T.inflected_pattern(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.rlike(F.replace(text, F.lit(" a "), F.lit(" ")), pattern).alias("named"), F.rlike(text, pattern).alias("apart"))


@query("""WITH t AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\\x{200b}-\\x{200d}\\x{feff}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS cleaned, sha256(coalesce(text, '')) AS fingerprint FROM t""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX16, TX38: spaces and invisible characters cleaned, and a fingerprint of the content as it came."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(T.clean_spaces(F.col("text"))).alias("cleaned"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))


@query("""WITH w AS (SELECT p_partkey AS id, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS ws FROM part), x AS (SELECT a.id, list_sort(list_intersect(a.ws, b.ws)) AS common FROM w a JOIN w b ON b.id = a.id + 1) SELECT id, CAST(len(common) AS BIGINT) AS shared, array_to_string(common[1:4], ',') AS sample FROM x""")
def shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR02: how many words two subjects share, and the first four of them."""
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")).alias("ws"))
    both = w.join(w.select((F.col("id") - 1).alias("id"), F.col("ws").alias("other")), "id").select("id", F.sort_array(F.array_intersect("ws", "other")).alias("both"))
    return both.select("id", F.size("both").cast("long").alias("shared"), F.array_join(F.slice("both", 1, 4), ",").alias("sample"))


@query("""WITH f AS (SELECT o_custkey AS party, o_orderpriority AS code, MIN(o_orderdate) AS first, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 1, 2) SELECT party, string_agg(code, ',' ORDER BY first, id) AS codes, COUNT(*) AS n FROM f GROUP BY 1""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR04: codes of a register in the order in which they first came up, each once."""
    f = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("party"), F.col("o_orderpriority").alias("code")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    return f.groupBy("party").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "code"))), lambda x: x["code"]), ",").alias("codes"), F.count(F.lit(1)).alias("n"))


@query("""WITH z AS (SELECT p_partkey AS id, p_brand AS k, p_type AS v, 0 AS pos FROM part UNION ALL SELECT p_partkey, p_type, p_brand, 1 FROM part), m AS (SELECT k, arg_min(v, (id, pos)) AS v, COUNT(DISTINCT v) AS offered FROM z GROUP BY 1) SELECT k AS key, v AS value, offered FROM m""")
def first_wins_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR05: keys and values of several lists zipped to one map; the first value of a key stays."""
    pairs = F.arrays_zip(F.array("p_brand", "p_type").alias("k"), F.array("p_type", "p_brand").alias("v"))
    z = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(pairs).alias("pos", "p"))
    return z.groupBy(F.col("p.k").alias("key")).agg(F.min_by("p.v", F.struct("p_partkey", "pos")).alias("value"), F.countDistinct("p.v").alias("offered"))


@query("""WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS day, year(o_orderdate) AS year FROM orders), p AS (SELECT id, year, CASE WHEN day IS NULL THEN 0.5 ELSE (dayofyear(day) - 1) / CAST(CASE WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 366 ELSE 365 END AS DOUBLE) END AS pos FROM d) SELECT id, pos AS position, CAST(floor((year - 1990 + pos) * 60 / 7 + 0.5) AS BIGINT) AS bin FROM p""")
def year_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN13: the place of a day within its year, the middle if only the year is known, and its bin on an axis."""
    y = F.col("year")
    length = F.when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 366).otherwise(365).cast("double")
    d = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 5 > 0, F.to_date("o_orderdate")).alias("day"))
    at = F.when(F.col("day").isNull(), 0.5).otherwise((F.dayofyear("day") - 1) / length)
    return d.withColumn("position", at).select("id", "position", F.floor((y - 1990 + F.col("position")) * 60 / 7 + 0.5).alias("bin"))
