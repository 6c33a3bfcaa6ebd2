"""Persons in texts, whatever the grammatical case: an index of name forms met by hashed pairs of words, and calls of speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicrill.operators.keyed import top_k

#: Endings of given name and surname in each case, for names on a consonant and for names on -a.
HARD = (("", ""), ("a", "a"), ("ovi", "ovi"), ("em", "em"))
SOFT = (("a", "a"), ("y", "y"), ("e", "e"), ("u", "u"), ("ou", "ou"))
#: Persons of a text at most.
MOST = 12
#: Words that give somebody the floor, and what may stand before the surname.
CALLS = "(?:[Ss]lovo m[áa]|[Pp]rosím|[Dd]ěkuji|[Hh]lásí se|[Vv]ystoupí)"
ADDRESS = "(?:\\s+[Pp]an[aíiu]?)?(?:\\s+(?:zastupitel|starost|radn|doktor)\\p{L}*)?"


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[^\\p{L}]+"), lambda w: w != "")


def _forms(name: Column, side: int) -> Column:
    """Forms of one name in all cases, lower case; a name on -a has forms of its own."""
    n = F.lower(name)
    stem = F.left(n, F.greatest(F.length(n) - 1, F.lit(0)))
    soft, hard = (F.array(*[F.concat(b, F.lit(e[side])) for e in ends]) for b, ends in ((stem, SOFT), (n, HARD)))
    return F.when(n.endswith("a"), soft).otherwise(hard)


def pair_forms(persons: DataFrame, person: str) -> DataFrame:
    """(given, surname, person): both names in one case, for forms that belong to one person alone.

    Where only one of both names ends in -a, each keeps its own endings; the cases that both have are paired in order.
    """
    both = F.arrays_zip(_forms(F.col("given"), 0).alias("g"), _forms(F.col("surname"), 1).alias("s"))
    each = persons.filter(f"{person} is not null").select(person, F.explode(both).alias("f")).select(F.col("f.g").alias("given"), F.col("f.s").alias("surname"), person)
    alone = each.filter("given is not null and surname is not null").groupBy("given", "surname")
    return alone.agg(F.min(person).alias(person), F.max(person).alias("__other")).filter(F.col(person) == F.col("__other")).drop("__other")


def mentions(texts: DataFrame, persons: DataFrame, key: str, person: str, text: str = "text", most: int = MOST) -> DataFrame:
    """(key, person, times, rank): the persons (person, given, surname) that a text names, most often first, ``most`` at most.

    Two words in a row with capitals meet the index by one hash of both; no text is scanned for each name. Equal numbers go
    by person. Repeated pairs of a text fold before the join. Forms that two persons share name nobody.
    """
    pair = lambda a, b: F.struct(F.lower(a).alias("given"), F.lower(b).alias("surname"))
    capital = lambda w: w.rlike("^\\p{Lu}")
    listed = texts.filter(f"{key} is not null").select(key, words(F.col(text)).alias("w"))
    following = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), following, lambda a, b: F.when(capital(a) & capital(b), pair(a, b))), lambda p: p.isNotNull())
    found = listed.select(key, F.explode(pairs).alias("p")).groupBy(key, "p").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("p.given", "p.surname"))
    index = pair_forms(persons, person).withColumn("h", F.xxhash64("given", "surname"))
    met = found.join(index, "h").filter((F.col("p.given") == F.col("given")) & (F.col("p.surname") == F.col("surname")))
    counts = met.groupBy(key, person).agg(F.sum("n").alias("times"))
    return top_k(counts, [key], most, F.desc("times"), F.col(person))


def surname_forms(persons: DataFrame, person: str) -> DataFrame:
    """(surname, person): forms of surnames that belong to one person alone."""
    each = persons.filter(f"{person} is not null").select(person, F.explode(_forms(F.col("surname"), 1)).alias("surname")).filter("surname is not null")
    return each.groupBy("surname").agg(F.min(person).alias(person), F.max(person).alias("__other")).filter(F.col(person) == F.col("__other")).drop("__other")


def called(text: Column) -> Column:
    """Surnames that a text gives the floor to, in lower case and in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"{CALLS}{ADDRESS}\\s+(\\p{{Lu}}\\p{{L}}{{2,}})"), F.lit(1)), F.lower)


def speakers(segments: DataFrame, persons: DataFrame, talk: str, at: str, person: str, text: str = "text") -> DataFrame:
    """(talk, at, person): who speaks in each segment: the last one called in it or before, null until somebody is.

    A call whose surname nobody has, or more than one, leaves the speaker as before. ``at`` orders the segments of a talk.
    """
    calls = segments.filter(f"{talk} is not null and {at} is not null").select(talk, at, F.posexplode(called(F.col(text))).alias("no", "surname"))
    known = calls.join(surname_forms(persons, person), "surname")
    last = known.groupBy(talk, at).agg(F.max_by(person, "no").alias("__called"))
    every = segments.filter(f"{talk} is not null and {at} is not null").select(talk, at).join(last, [talk, at], "left")
    so_far = Window.partitionBy(talk).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return every.select(talk, at, F.last("__called", ignorenulls=True).over(so_far).alias(person))
