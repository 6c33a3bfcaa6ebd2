"""Spans of regular expressions in whole texts, with code-point places, in Spark expressions only.

Matches are fenced with a control character, the text is split at the fences, and lengths of the pieces give
the places. Possessive patterns that begin at the last match's end or outside their own first class keep
Java's matcher linear and free of recursion on very long texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits pieces; in the text itself it is first replaced by another control character that no pattern names.
FENCE, STAND_IN = "\u0001", "\u0002"
SPAN = "struct<start:int,stop:int,no:int,kind:string,value:string,before:string,after:string>"
SPANS = f"array<{SPAN}>"
#: Characters of context on the left.
CONTEXT = 24
#: Elements of one run of a long array.
PART = 256


@dataclass(frozen=True)
class Finder:
    """kind, Java pattern, a test of a match, the part of a match that is its value, and a cheap test that every text with a match passes."""

    kind: str
    pattern: str
    test: Callable[[Column], Column] | None = None
    value: Callable[[Column], Column] | None = None
    hint: Callable[[Column], Column] | None = None

    def pieces(self, clean: Column) -> Column:
        """Matches at odd places, what lies between them at even ones; texts that cannot have a match are not searched."""
        cut = F.split(F.regexp_replace(clean, self.pattern, f"{FENCE}$0{FENCE}"), FENCE, -1)
        return F.when(self.hint(clean), cut).otherwise(F.array(clean)) if self.hint else cut


def holds(*parts: str) -> Callable[[Column], Column]:
    """A hint: the text has one of these strings."""
    return lambda text: reduce(Column.__or__, [text.contains(x) for x in parts])


def fenced(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), FENCE, STAND_IN)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for each row and use it several times."""
    return F.transform(F.array(value), use)[0]


def _scan(values: Column, start: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """``start`` and then the fold of ``start`` with each longer beginning of ``values``; quadratic, for short arrays."""
    grown = F.aggregate(values, F.struct(start.alias("at"), F.array(start).alias("out")), lambda s, x: let(fold(s["at"], x), lambda at: F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out"))))
    return grown["out"]


def _parts(values: Column) -> Column:
    """``values`` in runs of PART, the last one shorter; none of an empty array."""
    none = F.slice(F.array(values), F.lit(1), F.lit(0))
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PART).cast("int")), lambda k: F.slice(values, k * PART + 1, F.lit(PART)))).otherwise(none)


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of ``values`` the fold of 0 with all before it.

    Arrays cannot be appended to without a copy, so the folds of whole runs come first and each run is then scanned by
    itself: n * PART + (n / PART)^2 steps instead of n^2.
    """
    zero = F.lit(0)

    def scan(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, fold))
        each = F.zip_with(parts, _scan(totals, zero, fold), lambda p, at: F.when(p.isNotNull(), _scan(p, at, fold)))
        return F.flatten(F.transform(F.filter(each, lambda e: e.isNotNull()), lambda e: F.slice(e, F.lit(1), F.size(e) - 1)))

    return let(let(values, _parts), scan)


def find_all(clean: Column, **groups: tuple[Finder, ...]) -> Column:
    """A struct with, for each group of finders, the leftmost non-overlapping matches of each finder that pass its test, by finder and place.

    ``clean`` comes from fenced(). A span's no is its finder's number; numbers go on from group to group.
    """
    finders = [f for g in groups.values() for f in g]
    none = F.array().cast(SPANS)

    def spans(f: Finder, no: int, p: Column, at: Column) -> Column:
        def span(i: Column) -> Column:
            return F.struct(
                at[i].alias("start"),
                (at[i] + F.length(p[i])).alias("stop"),
                F.lit(no).alias("no"),
                F.lit(f.kind).alias("kind"),
                (f.value(p[i]) if f.value else p[i]).alias("value"),
                F.right(p[i - 1], F.lit(CONTEXT)).alias("before"),
                F.left(p[i + 1], F.lit(1)).alias("after"),
            )

        odd = F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))
        found = F.transform(F.filter(odd, lambda i: F.coalesce(f.test(p[i]), F.lit(False))) if f.test else odd, span)
        return F.when(F.size(p) > 1, found).otherwise(none)

    pieces = F.array(*[f.pieces(clean) for f in finders])
    # places of all pieces of all finders, worked out by one expression
    placed = F.transform(pieces, lambda p: F.struct(p.alias("p"), F.when(F.size(p) > 1, running(F.transform(p, lambda x: F.length(x)), lambda a, b: a + b)).alias("at")))
    numbers = iter(range(len(finders)))
    own = {name: [(f, next(numbers)) for f in g] for name, g in groups.items()}
    return let(placed, lambda found: F.struct(*[F.concat(*[spans(f, no, found[no]["p"], found[no]["at"]) for f, no in each]).alias(name) for name, each in own.items()]))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with every span (structs with start and stop, by start; they may overlap) replaced by ``mask``.

    The text is cut at every PART-th span first and each cut at its own spans: no span looks for its place from the
    text's beginning.
    """
    ends = running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
    joined_ends = F.zip_with(spans, ends, lambda s, e: F.struct(e.alias("free"), s["start"].alias("start"), s["stop"].alias("stop")))
    fresh = F.filter(joined_ends, lambda s: s["start"] >= s["free"])

    def run(p: Column) -> Column:
        first, last = p[0]["free"], p[F.size(p) - 1]["start"]
        body = F.substring(text, first + 1, last - first)
        return let(body, lambda b: F.array_join(F.transform(p, lambda s: F.concat(F.substring(b, s["free"] - first + 1, s["start"] - s["free"]), F.lit(mask))), ""))

    whole = let(let(fresh, _parts), lambda parts: F.array_join(F.transform(parts, run), ""))
    rest = F.greatest(F.lit(0), F.array_max(F.transform(spans, lambda s: s["stop"])))
    return F.when(F.size(spans) > 0, F.concat(whole, F.substring(text, rest + 1, F.length(text)))).otherwise(text)


def runs(spans: Column) -> Column:
    """Spans by start, in runs with their outer ends, for touches()."""
    listed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    return F.transform(let(listed, _parts), lambda p: F.struct(p[0]["start"].alias("low"), F.array_max(F.transform(p, lambda s: s["stop"])).alias("high"), p.alias("spans")))


def touches(grouped: Column, s: Column) -> Column:
    """Whether ``s`` overlaps any span of runs(); only runs that it overlaps are looked through."""
    meets = lambda a, b: (a < s["stop"]) & (s["start"] < b)
    return F.exists(grouped, lambda r: meets(r["low"], r["high"]) & F.exists(r["spans"], lambda b: meets(b["start"], b["stop"])))


def joined(spans: Column) -> Column:
    """kind:start:stop by place, then by the order of the kinds, comma-joined; ``spans`` are sorted structs."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def ordered(spans: Column) -> Column:
    return F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["stop"].alias("stop"), s["kind"].alias("kind"))))


def many(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
