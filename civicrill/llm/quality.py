"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each rule names a ratio of the measured columns and the range in which a text passes. The table is data;
compile_rules() turns it into one expression, so a change of thresholds never changes the plan's shape.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    *("the", "be", "to", "of", "and", "that", "have", "with", "is", "it", "for", "as", "was", "on", "are", "this", "by", "an", "in", "a"),
    *("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "den", "im", "auf", "für", "sich", "dem", "des"),
    *("le", "la", "les", "et", "de", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "est", "du", "avec"),
    *("el", "los", "las", "y", "en", "se", "del", "por", "con", "para", "una", "es", "no", "su"),
)


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= numerator / denominator <= high; without denominator the numerator itself counts."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None


THRESHOLDS = (
    Rule("words", "n_words", None, 50, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2, 12),
    Rule("symbols", "n_symbols", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", "n_words", low=0.03),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
    Rule("shouted_words", "n_capital_words", "n_words", high=0.5),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), use)[0]


def _covered(at: Column) -> Column:
    """Words inside 3-word windows that start at the ascending places ``at`` (not empty)."""
    return _let(F.size(at), lambda n: F.aggregate(F.zip_with(F.slice(at, F.lit(1), n - 1), F.slice(at, F.lit(2), n - 1), lambda a, b: F.least(F.lit(3), b - a)), F.lit(3).cast("long"), lambda s, x: s + x))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are sorted as (hash, place), and equal neighbours are compared word by word. Should two unequal windows of a
    text ever share a hash, its windows are sorted as strings instead.
    """

    def places(s: Column, same: Callable[[Column, Column], Column]) -> Column:
        n = F.size(s)
        twins = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))

    def covered(at: Column) -> Column:
        return F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(_covered(at))

    starts = F.sequence(F.lit(0), F.size(words) - 3)
    alike = lambda i, j: (words[i] == words[j]) & (words[i + 1] == words[j + 1]) & (words[i + 2] == words[j + 2])

    def by_hash(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))

        def judged(s: Column) -> Column:
            n = F.size(s)
            clash = F.exists(F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: (a["w"] == b["w"]) & ~alike(a["i"], b["i"])), lambda x: x)
            return F.when(clash, by_string()).otherwise(_let(places(s, lambda a, b: a["w"] == b["w"]), covered))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(pairs, judged))

    def by_string() -> Column:
        windows = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("i")))
        return _let(places(F.sort_array(windows), lambda a, b: a["w"] == b["w"]), covered)

    hashes = F.transform(starts, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(hashes, by_hash))


def measure(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id and the measured counts (long). Null text has no words, lines or symbols."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        F.filter(F.split(body, BLANK), lambda w: w != "").alias("__words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counted = {
        "word_chars": F.length(F.array_join("__words", "")),
        "n_words": F.size("__words"),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": repeat_words(F.col("__words")),
        "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_capital_words": F.size(F.filter("__words", lambda w: (F.upper(w) == w) & (F.length(F.translate(F.lower(w), "0123456789", "")) > 1) & (F.lower(w) != w))),
    }
    return split.select("doc_id", "n_symbols", *[c.cast("long").alias(k) for k, c in counted.items()])


def compile_rules(rules: tuple[Rule, ...] = THRESHOLDS) -> tuple[Column, Column]:
    """(passes, names of failed rules) over measured columns; a ratio without a denominator's value fails no rule."""
    failed = []
    for r in rules:
        value = F.col(r.numerator).cast("double") if r.denominator is None else F.try_divide(F.col(r.numerator), F.col(r.denominator))
        outside = [*([value < r.low] if r.low is not None else []), *([value > r.high] if r.high is not None else [])]
        failed.append(F.when(reduce(Column.__or__, outside), F.lit(r.name)))
    names = F.array_compact(F.array(*failed))
    return F.size(names) == 0, names


def judge(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """measure() with base_failed, kept and failed_rules. Wordless and null texts are never kept; repeated rows stay apart."""
    passes, names = compile_rules(rules)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes).alias("kept"), F.array_join(names, ",").alias("failed_rules"))
