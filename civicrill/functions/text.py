"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their base letters (Latin-1 and Latin Extended-A); letters that do not decompose, such as ß, stay.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"

STOP_WORDS = ("with", "that", "this", "from", "have", "pour", "dans", "avec", "nicht", "eine", "para")


def unaccent(text: Column) -> Column:
    """Lower case, marks removed."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def slug(text: Column, length: int = 80) -> Column:
    """Lower-case words joined by hyphens, cut to ``length``; unnamed when nothing is left."""
    body = F.regexp_replace(F.regexp_replace(unaccent(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(body, 1, length), "-+$", ""), F.lit("")), F.lit("unnamed"))


def word_string(text: Column) -> Column:
    """Unaccented words separated by single spaces."""
    return F.trim(F.regexp_replace(unaccent(text), "[^a-z0-9]+", " "))


def word_list(text: Column) -> Column:
    return F.filter(F.split(word_string(text), " "), lambda w: w != "")


def stem(word: Column) -> Column:
    """Endings cut: two letters of long words, one of middling ones."""
    n = F.length(word)
    return F.when(n >= 7, F.substring(word, F.lit(1), n - 2)).when(n >= 5, F.substring(word, F.lit(1), n - 1)).otherwise(word)


def significant_words(text: Column, shortest: int = 4) -> Column:
    """Distinct words of ``shortest`` letters or more that are neither numbers nor stop words, in order of first use."""
    return F.array_distinct(F.filter(word_list(text), lambda w: (F.length(w) >= shortest) & ~w.rlike("^[0-9]+$") & ~w.isin(*STOP_WORDS)))


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(significant_words(text), stem))


LEGAL_FORMS = ("spol s r o", "s r o", "a s", "sro", "as", "gmbh", "ltd", "inc", "z s", "o p s", "sa", "sarl")


def core_name(name: Column) -> Column:
    """A company's name without trailing legal forms, as a word string."""
    return F.trim(F.regexp_replace(word_string(name), "(?: (?:" + "|".join(LEGAL_FORMS) + "))+$", ""))


def usable_core(core: Column) -> Column:
    """Long enough to identify somebody, and no placeholder."""
    return (F.length(core) >= 5) & ~core.rlike("^(?:unknown|anonym|private)")


def inflected_pattern(core: Column) -> Column:
    """A pattern that finds a name in other grammatical cases: stems with free endings."""
    return F.concat(F.lit("\\b"), F.array_join(F.transform(F.split(core, " "), stem), "[a-z0-9]*\\s+"), F.lit("[a-z0-9]*\\b"))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def company_ids(text: Column) -> Column:
    """Company ids: 5 to 8 digits after an id label, padded to 8."""
    found = F.transform(F.regexp_extract_all(unaccent(text), F.lit("\\bico?:? ?([0-9][0-9 ]{3,9}[0-9])"), F.lit(1)), digits_only)
    return F.transform(F.filter(found, lambda x: F.length(x).between(5, 8)), lambda x: F.lpad(x, 8, "0"))


def contract_numbers(text: Column) -> Column:
    """Runs of digits, slashes and hyphens with at least six digits."""
    return F.filter(F.regexp_extract_all(text, F.lit("[0-9][0-9/-]*[0-9]"), F.lit(0)), lambda x: F.length(digits_only(x)) >= 6)


def amendment_number(text: Column) -> Column:
    """Number of the amendment that a text names; null without one."""
    return F.nullif(F.regexp_extract(unaccent(text), "\\b(?:dodatk(?:u|y|em)|dodatek|amendment) ?(?:c\\.?|no\\.?)? ?([0-9]{1,4})", 1), F.lit("")).try_cast("int")


def is_amendment(text: Column) -> Column:
    return unaccent(text).rlike("\\b(?:dodatk(?:u|y|em)|dodatek|amendment)")


MONEY = "([0-9]{1,3}(?:[ .][0-9]{3})+|[0-9]+)(?:,([0-9]{1,2}|-))? ?(tis\\.?|mil\\.?|mld\\.?)? ?(?:kc|czk|eur)"
CEILING = 1_000_000_000


def amounts(text: Column) -> Column:
    """All amounts of money in a text (double): groups of three digits, decimal comma, thousands, millions, billions."""
    plain = F.translate(unaccent(text), "\u00a0", " ")
    found = F.arrays_zip(*[F.regexp_extract_all(plain, F.lit(MONEY), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)])

    def value(x: Column) -> Column:
        whole = F.regexp_replace(x["g1"], "[ .]", "").try_cast("double")
        part = F.coalesce(F.concat(F.lit("0."), F.nullif(F.nullif(x["g2"], F.lit("-")), F.lit(""))).try_cast("double"), F.lit(0.0))
        unit = F.when(x["g3"].startswith("tis"), 1e3).when(x["g3"].startswith("mil"), 1e6).when(x["g3"].startswith("mld"), 1e9).otherwise(1.0)
        return (whole + part) * unit

    return F.filter(F.transform(found, value), lambda v: v.isNotNull())


def largest_amount(text: Column) -> Column:
    """The largest amount up to the ceiling; null without one. Unknown is not zero."""
    return F.array_max(F.filter(amounts(text), lambda v: v <= CEILING))


def signed_number(text: Column) -> Column:
    """Numbers with a trailing minus sign; blank is null."""
    t = F.trim(text)
    return F.when(t == "", None).when(t.endswith("-"), -F.replace(F.left(t, F.length(t) - 1), F.lit(","), F.lit(".")).try_cast("double")).otherwise(F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def clean_spaces(text: Column) -> Column:
    """Hard spaces become spaces, zero-width and control characters go, runs collapse, at most one empty line stays."""
    t = F.regexp_replace(F.translate(text, "\u00a0", " "), "[\\u200b-\\u200d\\ufeff\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), "\n{3,}", "\n\n"))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments out, block ends become line ends, other tags spaces."""
    t = F.regexp_replace(html, "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, "(?i)<br[^>]*>|</(?:p|div|li|h[1-6]|tr|title)>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), "[ \\t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(unescape(t), " ?\n ?", "\n"), "\n{2,}", "\n"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters, the others sorted, no trailing slash."""
    base = F.regexp_replace(url, "#.*$", "")
    path = F.regexp_replace(F.split_part(base, F.lit("?"), F.lit(1)), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(base, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[a-z]+|ref|fbclid|gclid)=")))
    return F.concat(F.lower(F.regexp_extract(path, "^[a-zA-Z]+://[^/]*", 0)), F.regexp_replace(path, "^[a-zA-Z]+://[^/]*", ""), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


TITLES = ("mgr", "ing", "bc", "judr", "mudr", "phd", "csc", "mba", "dr", "doc", "prof")


def person_slug(name: Column) -> Column:
    """surname-firstname of a titled name; null when fewer than two words stay."""
    words = F.filter(F.split(word_string(F.split_part(name, F.lit(","), F.lit(1))), " "), lambda w: (w != "") & ~w.isin(*TITLES))
    return F.when(F.size(words) >= 2, F.concat_ws("-", F.element_at(words, -1), F.element_at(words, 1)))


def name_key(name: Column) -> Column:
    """Words of a name as a sorted set, so that order does not matter."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(word_list(name), lambda w: F.length(w) >= 2))), " ")


def plural(n: Column, one: str, few: str, many: str) -> Column:
    return F.when(F.abs(n) == 1, one).when(F.abs(n).between(2, 4), few).otherwise(many)


def file_bytes(text: Column) -> Column:
    """29,64 MB as bytes, in decimal units; null if unreadable."""
    number = F.replace(F.regexp_extract(text, "([0-9]+(?:[.,][0-9]+)?) ?([kMG]?)B", 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.regexp_extract(text, "([0-9]+(?:[.,][0-9]+)?) ?([kMG]?)B", 2)
    return (number * F.when(unit == "k", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).otherwise(1.0)).cast("long")


def expand_numbers(text: Column) -> Column:
    """"3, 08-11" as 3, 8, 9, 10, 11; spans above 20 and text parts are left out."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]{1,4})(?:-([0-9]{1,4}))?"), F.lit(0))

    def span(p: Column) -> Column:
        a, b = F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.nullif(F.split_part(p, F.lit("-"), F.lit(2)), F.lit("")).cast("int")
        return F.when(b.isNull(), F.array(a)).when((b >= a) & (b - a <= 20), F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(parts, span))


def content_key(text: Column) -> Column:
    """Letters and digits only, unaccented: equal for texts that differ in spacing and punctuation."""
    return F.regexp_replace(unaccent(text), "[^a-z0-9]", "")


def vowelless_share(text: Column) -> Column:
    """Share of the words of four letters and more that have no vowel; null without such words."""
    long = F.filter(word_list(text), lambda w: F.length(w) >= 4)
    return F.try_divide(F.size(F.filter(long, lambda w: ~w.rlike("[aeiouy]"))).cast("double"), F.size(long).cast("double"))
