"""Minutes of meetings taken apart: who was there, the points of the agenda, and what was resolved on each of them.

All are Column expressions over one text, so minutes are read in place and nothing is shuffled. A part that the minutes do not
have is null; an empty list never stands for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicrill.functions.text import unaccent

# Headings of Czech minutes and the verbs by which a body says what it wants. A denial stands before its verb.
HEADINGS = {"present": "přítomni", "absent": "nepřítomni", "excused": "omluveni", "unexcused": "neomluveni", "guests": "hosté", "recorder": "zapsala?"}
DIRECTIONS = (
    ("advises against", "nedoporuc"),
    ("recommends", "doporuc"),
    ("disagrees", "nesouhlas"),
    ("agrees", "souhlas|odsouhlas"),
    ("asks", "zada"),
    ("proposes", "navrhuj"),
    ("orders", "uklada"),
    ("approves", "schvaluj|schvalil"),
    ("notes", "bere na vedomi"),
)
REFUSED = "\\b(?:nebyl[aoy]? (?:prijat|schvalen)|neprijat|neschvalen|neprosl)"
ADOPTED = "\\b(?:prijat|schvalen)[aoy]?\\b"
#: Each text that the two patterns find has one of these.
STATES = ("prijat", "schvalen", "prosl")
#: Members only; guests may have their firm in brackets and are kept as they stand.
MEMBERS = ("present", "absent", "excused", "unexcused")
#: A resolution is cited up to this length and marked as cut beyond it; shorter than the least it is no more than a heading.
LONGEST, LEAST = 700, 12

_ANY = "|".join(HEADINGS.values())
_POINT = "\n(?=[ \\t]*[0-9]{1,2}[.)][ \\t]+\\p{L})"
_RESOLVED = "\n(?=[ \\t]*(?i:usnesení)(?:[ \\t]+č\\.[ \\t]*[0-9/]+)?[ \\t]*:)"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` has it in many places or in a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def section(text: Column, heading: str) -> Column:
    """What follows a heading at the start of a line, up to the next heading, numbered point or empty line; null without it."""
    start = f"(?iu)(?:^|\n)[ \\t]*(?:{heading})[ \\t]*:"
    end = f"(?=\n[ \\t]*(?:{_ANY})[ \\t]*:|\n[ \\t]*[0-9]{{1,2}}[.)][ \\t]|\n[ \\t]*(?:\n|\\z)|\\z)"
    return F.when(text.rlike(start), F.trim(F.regexp_extract(text, f"{start}(?s:(.*?)){end}", 1)))


def named(part: Column) -> Column:
    """The entries of a list, split at commas, semicolons and line ends outside brackets; spaces collapse, blank ones go."""
    entries = F.split(F.regexp_replace(part, "\n", ", "), "[,;](?![^()]*\\))")
    return F.filter(F.transform(entries, lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), lambda x: x != "")


def member(entry: Column) -> Column:
    """A member's entry without titles and without remarks in brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(entry, "\\([^()]*\\)|(?<!\\S)\\S+\\.(?!\\S)", " "), "\\s+", " "))


def _capitals(entry: Column) -> Column:
    return F.size(F.filter(F.split(entry, " "), lambda w: w.rlike("^\\p{Lu}")))


def is_name(entry: Column) -> Column:
    """Two or three words, all with a capital."""
    words = F.size(F.split(entry, " "))
    return words.between(2, 3) & (_capitals(entry) == words)


def is_run_together(entry: Column) -> Column:
    """Two names without anything between them: more capitals than a name has, or too long for one."""
    return ~is_name(entry) & ((_capitals(entry) >= 4) | (F.length(entry) > 45))


def header(text: Column) -> Column:
    """A struct of one list for each heading, and ``damaged`` where names of members run together.

    Titles and remarks of members go, and an entry that is no name then; a list of which nothing is left is null, since the
    minutes do not tell the names.
    """
    lists = {key: named(section(text, heading)) for key, heading in HEADINGS.items()}
    lists |= {key: F.transform(lists[key], member) for key in MEMBERS}

    def told(x: Column) -> Column:
        kept = {key: F.filter(x[key], is_name) if key in MEMBERS else x[key] for key in HEADINGS}
        damaged = [F.coalesce(F.exists(x[key], is_run_together), F.lit(False)) for key in MEMBERS]
        fields = [F.nullif(value, F.array().cast("array<string>")).alias(key) for key, value in kept.items() if key != "recorder"]
        return F.struct(*fields, F.get(x["recorder"], F.lit(0)).alias("recorder"), F.array_contains(F.array(*damaged), True).alias("damaged"))

    return once(F.struct(*[value.alias(key) for key, value in lists.items()]), told)


def _rest(parts: Column) -> Column:
    """All but the first."""
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _items(text: Column) -> Column:
    """The numbered points, each with what stands below it; what comes before the first one is left out."""
    return once(F.split(F.concat(F.lit("\n"), text), _POINT), _rest)


def _first_line(item: Column) -> Column:
    return F.split_part(item, F.lit("\n"), F.lit(1))


def agenda(text: Column) -> Column:
    """Titles of the numbered points in order, each once."""
    return F.array_distinct(F.transform(_items(text), lambda x: F.trim(F.regexp_replace(_first_line(x), "^[ \\t]*[0-9]{1,2}[.)][ \\t]+", ""))))


def _any(text: Column, *parts: str) -> Column:
    """Whether a text has one of these; costs far less than a pattern, and tells most texts that a pattern need not be tried."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def direction(text: Column) -> Column:
    """What the body wants, by the first verb of the list that the text has; null without one."""
    says = lambda plain, verb: _any(plain, *verb.split("|")) & plain.rlike(f"\\b(?:{verb})")
    return once(unaccent(text), lambda plain: F.coalesce(*[F.when(says(plain, verb), F.lit(name)) for name, verb in DIRECTIONS]))


def adopted(text: Column) -> Column:
    """False where the minutes say that it failed, true where they say that it passed; null where they are silent."""
    return once(unaccent(text), _adopted)


def _adopted(plain: Column) -> Column:
    return F.when(_any(plain, *STATES), F.when(plain.rlike(REFUSED), False).when(plain.rlike(ADOPTED), True))


def _votes(plain: Column, word: str) -> Column:
    number = F.regexp_extract(plain, f"\\b{word}(?: se)?[ :]{{1,3}}([0-9]{{1,3}})\\b", 1).try_cast("long")  # no match is an empty text, which is no number
    return F.when(plain.contains(word.split("[")[0]), number)


def _cited(body: Column, source: str, state: Column, polled: Column | None) -> Column:
    """``polled``: a text without marks that tells the poll."""

    def row(told: Column) -> Column:
        return F.struct(
            F.lit(source).alias("source"),
            F.left(told, F.lit(LONGEST)).alias("text"),
            (F.length(told) > LONGEST).alias("cut"),
            direction(told).alias("direction"),
            state.alias("adopted"),
            *[(F.lit(None).cast("long") if polled is None else _votes(polled, word)).alias(name) for name, word in (("in_favour", "pro"), ("against", "proti"), ("abstained", "zdrzel[ai]?"))],
        )

    return once(F.trim(F.regexp_replace(body, "\\s{2,}|[^\\S ]", " ")), row)  # a single space stays


def _resolved(item: Column) -> Column:
    """Blocks under a heading, and sentences of the body itself where it wrote no block.

    A block ends before its poll, an empty line or a row of asterisks. Whether it was adopted may be told above the first block,
    below it, or both; below counts up to the next block, above only for the first one. What stands above is read once for all
    sentences in it.
    """

    def block(part: Column, i: Column, above: Column) -> Column:
        def told(body: Column) -> Column:
            own = F.regexp_replace(body, "(?is)(?:hlasování|\\*{5}|\n(?:[ \\t]*(?:\n|pro[ \\t]*:)|[^\n]*(?:přijat|schválen)[aoy]?\\.)).*", "")
            return once(unaccent(body), lambda plain: _cited(own, "block", once(F.concat_ws("\n", F.when(i == 0, unaccent(above)), plain), _adopted), plain))

        return once(F.substr(part, F.instr(part, ":") + 1), told)

    def sentences(above: Column) -> Column:
        lines = F.split(F.substr(above, F.lit(2)), "(?<=[.!?])\\s+|\n")
        own = F.filter(lines, lambda s: s.rlike("(?iu)^\\s*(?:komise|výbor)\\s") & direction(s).isNotNull())
        return F.when(above.rlike("(?iu)(?:komise|výbor)\\s"), F.array_distinct(own)).otherwise(F.array().cast("array<string>"))

    def said(own: Column, above: Column) -> Column:
        return once(F.when(F.size(own) > 0, adopted(above)), lambda state: F.transform(own, lambda s: _cited(s, "sentence", state, None)))

    def told(x: Column) -> Column:
        new = F.filter(x["said"], lambda s: ~F.exists(x["blocks"], lambda b: b["text"] == s["text"]))
        return F.filter(F.concat(x["blocks"], new), lambda y: F.length(y["text"]) >= LEAST)

    def both(x: Column) -> Column:
        blocks = F.transform(_rest(x["parts"]), lambda part, i: block(part, i, x["above"]))
        return once(F.struct(blocks.alias("blocks"), once(sentences(x["above"]), lambda own: said(own, x["above"])).alias("said")), told)

    # ``above``: what stands above the first block, without the title
    above = lambda parts: once(F.instr(parts[0], "\n"), lambda end: F.when(end > 0, F.substr(parts[0], end)).otherwise(""))
    return once(once(F.when(item.contains(":"), F.split(item, _RESOLVED)).otherwise(F.array(item)), lambda parts: F.struct(parts.alias("parts"), above(parts).alias("above"))), both)


def resolutions(text: Column) -> Column:
    """All resolutions of the minutes in order, each with the number of its point in the agenda (from 1)."""
    fields = ("source", "text", "cut", "direction", "adopted", "in_favour", "against", "abstained")

    def placed(item: Column, i: Column) -> Column:
        return F.transform(_resolved(item), lambda r: F.struct((i + 1).cast("long").alias("point"), *[r[name].alias(name) for name in fields]))

    return F.flatten(F.transform(_items(text), placed))
