"""Minutes taken apart on planted texts, and names in sentences against brute force."""

import random

from pyspark.sql import functions as F

from civicrill.operators.minutes import agenda, header, resolutions
from civicrill.operators.naming import longest_named

TEXT = """Zápis z jednání komise
Přítomni: Ing. Jan Novák, Petr Malý (od 15:00)
  Eva Dlouhá
OMLUVENI:  viz prezenční listina
Neomluveni:
Hosté: Karel Host (Stavby, s. r. o.); Město
Zapsala: Jana Nová

5. 1. 2026
1. Dotace na sport
Komise byla seznámena s žádostí.
Usnesení č. 3/26: Komise nedoporučuje
schválit dotaci.
Hlasování: pro 5, proti 1, zdržel se 0
Usnesení: Komise doporučuje nižší částku 300 tis. Kč.
PRO: 2 PROTI: 4 ZDRŽEL SE: 0
Návrh nebyl přijat, přijato bude příště.
2) Různé
Komise doporučuje opravit lavičky. Pan Malý doporučuje víc.
Výbor bere na vědomí zprávu o plnění.
1. Dotace na sport
Usnesení: bod 1
"""


def rows(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return [r["x"] for r in df.select("id", column(F.col("text")).alias("x")).orderBy("id").collect()]


def test_header_tells_missing_from_unreadable(spark):
    h = rows(spark, [TEXT], header)[0].asDict()
    assert h["present"] == ["Jan Novák", "Petr Malý", "Eva Dlouhá"]
    assert h["excused"] is None and h["absent"] is None and h["unexcused"] is None
    assert h["guests"] == ["Karel Host (Stavby, s. r. o.)", "Město"]
    assert h["recorder"] == "Jana Nová" and h["damaged"] is False


def test_names_that_run_together_damage_the_header(spark):
    h = rows(spark, ["Přítomni: Jan Novák Petr Malý, Eva Dlouhá", "Hosté: Jan Novák Petr Malý Eva", "Nepřítomni: Jan Novák"], header)
    assert [x["damaged"] for x in h] == [True, False, False]
    assert h[0]["present"] == ["Eva Dlouhá"] and h[1]["present"] is None
    assert h[2]["present"] is None and h[2]["absent"] == ["Jan Novák"]


def test_agenda_has_each_title_once_and_no_dates(spark):
    assert rows(spark, [TEXT], agenda) == [["Dotace na sport", "Různé"]]


def test_resolutions_with_votes_and_adoption(spark):
    got = [(r["point"], r["source"], r["text"], r["direction"], r["adopted"], r["in_favour"], r["against"], r["abstained"]) for r in rows(spark, [TEXT], resolutions)[0]]
    assert got == [
        (1, "block", "Komise nedoporučuje schválit dotaci.", "advises against", None, 5, 1, 0),
        (1, "block", "Komise doporučuje nižší částku 300 tis. Kč.", "recommends", False, 2, 4, 0),
        (2, "sentence", "Komise doporučuje opravit lavičky.", "recommends", None, None, None, None),
        (2, "sentence", "Výbor bere na vědomí zprávu o plnění.", "notes", None, None, None, None),
    ]


def test_state_above_counts_for_the_first_block_only(spark):
    text = "1. Bod\nNávrh byl schválen.\nUsnesení: Komise souhlasí s pronájmem.\nUsnesení: Komise souhlasí s prodejem."
    assert [r["adopted"] for r in rows(spark, [text], resolutions)[0]] == [True, None]


def test_null_empty_and_very_long_texts(spark):
    long = "1. Bod\nUsnesení: Komise doporučuje " + "velmi " * 60_000 + "\n\nUsnesení bylo přijato."
    none, empty, told = rows(spark, [None, "", long], resolutions)
    assert not none and empty == [] and len(told) == 1
    assert told[0]["cut"] and len(told[0]["text"]) == 700 and told[0]["adopted"] is True
    h = rows(spark, [None, ""], header)
    assert all(x["present"] is None and x["recorder"] is None and not x["damaged"] for x in h)


def test_longest_name_equals_brute_force(spark):
    rng = random.Random(7)
    words = ["odbor", "rozvoje", "města", "dopravy", "školství", "a", "majetku", "kultury", "úřad"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(40)] + [None, "odbor", "odbor dopravy", "odbor dopravy"]
    texts = [" ".join(w + rng.choice(["", "u"]) for w in rng.choices(words, k=rng.randint(0, 7))) for _ in range(150)] + [None, "", "Odboru DOPRAVY!"]
    sentences = [(i % 120, t) for i, t in enumerate(texts)]  # some ids have two sentences

    def stems(t, least=1):
        plain = (t or "").lower().translate(str.maketrans("ěščřžýáíéůúň", "escrzyaieuun"))
        return {w[:5] for w in "".join(c if c.isalnum() else " " for c in plain).split() if len(w) >= least}

    def best(t):
        fits = [n for n in names if n and len(stems(n, 2)) >= 2 and stems(n, 2) <= stems(t)]
        return max(fits, key=lambda n: (len(n), n.encode())) if fits else None

    got = longest_named(spark.createDataFrame(sentences, "id long, t string"), spark.createDataFrame([(n,) for n in names], "name string"), "id", "t", "name")
    key = lambda r: (r[0], r[1] or "")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, best(t)) for i, t in sentences), key=key)
    none = spark.createDataFrame([], "name string")
    assert {r[1] for r in longest_named(spark.createDataFrame(sentences, "id long, t string"), none, "id", "t", "name").collect()} == {None}


def test_a_point_is_taken_apart_once(spark):
    """The plan splits a point into its blocks, and looks for its poll, at one place; odd spaces, colons and states change nothing."""
    texts = ["1. Bod\n\tVýbor \t bere na vědomí zprávu.\nUsnesení:\u00a0Komise souhlasí\ts  tím.  hlasování: PRO : 7\nNeschváleno. Bylo přijato.", "1. Bod: x\nKomise žádá o to.\nNávrh byl schválen.\n2. Jen titul", "1. Bod\nUsnesení: Komise žádá o to.\n pro: 3\nUsnesení: *****"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(resolutions(F.col("text")).alias("r"))
    got = [[(r["point"], r["source"], r["text"], r["direction"], r["adopted"], r["in_favour"]) for r in row["r"]] for row in df.collect()]
    assert got[1] == [(1, "sentence", "Komise žádá o to.", "asks", True, None)]
    assert got[2] == [(1, "block", "Komise žádá o to.", "asks", None, 3)]
    assert [r[1] for r in got[0]] == ["block", "sentence"] and got[0][0][3:] == ("agrees", False, 7) and got[0][1][2] == "Výbor bere na vědomí zprávu."
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("usnesení") == 1 and plan.count("zdrzel") == 2  # the pattern, and the text that says whether to try it
