"""Personal data by candidate gradient boosting, in DataFrame functions only.

Strict finders give the base spans. High-recall generators propose wider, overlapping spans; boosted trees over
format and context features score them, and a threshold calibrated for each generator on held-out documents
selects further redactions. Two models are fitted. For the first, a proposal is a positive example when it covers a
base span: the trees learn what personal data look like in this corpus, without the checks (check digits, ranges)
that made the base spans. A number whose check digit fails is never selected, nor an example of either. The second is for formats that no base pattern has: proposals that cover a base span are
left out, and a weak label that the base patterns do not define (check digits of an account, a valid IPv6 address, a
written-out mail address, a cue before a number) makes a positive example. Either may select. Generators of a strict form
find the parts of longer runs, such as two cards side by side, which a base pattern takes as one match and drops.
"""

from __future__ import annotations

from functools import reduce
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicrill.llm.boosting import Model, Pattern, fit, threshold
from civicrill.llm.common import cut
from civicrill.llm.spans import Finder, fenced, find_all, holds, joined, let, many, ordered, runs, touches

NOT_DIGIT = "[^0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, NOT_DIGIT, "")


def _card(x: Column) -> Column:
    d = digits(x)
    return F.length(d).between(14, 19) & F.call_function("luhn_check", d)


MAIL_LEFT = "[A-Za-z0-9._%+-]"
BASE = (
    Finder("email", f"(?:\\G|(?<!{MAIL_LEFT})){MAIL_LEFT}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", hint=holds("@")),
    Finder("ip", "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", lambda x: x.rlike(f"^{PART}(?:\\.{PART}){{3}}$"), hint=lambda t: t.rlike("\\.[0-9]")),
    Finder("card", "[0-9](?:[\\x20-]?[0-9]){13,}+", _card),
    Finder("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", lambda x: F.length(digits(x)).between(10, 15), hint=holds("+")),
)
#: Generators for high recall; their spans overlap one another and the base spans.
PROPOSED = (
    Finder("mailbox", f"(?:\\G|(?<!{MAIL_LEFT})){MAIL_LEFT}{{1,64}}+(?:\\x20?[@＠]\\x20?|\\x20?[\\[(](?:at|AT)[\\])]\\x20?)[A-Za-z0-9-]{{1,63}}+(?:\\x20?(?:\\.|[\\[(](?:dot|DOT)[\\])])\\x20?[A-Za-z0-9-]{{1,63}}+){{1,8}}+"),
    Finder("number", "[+(]?[0-9](?:[\\x20()./-]{0,3}[0-9]){6,30}+"),
    Finder("address", "(?:\\G|(?<![0-9A-Fa-f:.]))(?:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+|[0-9A-Fa-f]{1,4}+(?:[:.][0-9A-Fa-f]{1,4}+){3,7}+)", hint=lambda t: t.rlike("[:.][0-9A-Fa-f]")),
    Finder("account", "[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}+(?:\\x20?[A-Z0-9]{1,3})?"),
    Finder("digits", "(?:\\G|(?<![0-9]))[0-9]{14,19}+(?![0-9])"),
    Finder("dialled", "\\+[0-9]{1,3}[\\x20.-]?(?:\\([0-9]{2,4}\\)|[0-9]{2,4})[\\x20.-]?[0-9]{3,4}[\\x20.-]?[0-9]{4}(?![0-9])", hint=holds("+")),
)
#: Generators of a strict form: a part of a longer run that a base pattern takes as a whole and then drops. Their weak
#: labels hold for spans that base spans cover, too, which makes examples of them.
STRICT = ("digits", "dialled")
#: Words that announce personal data, as text before a span; fixed list.
CUES = "(?i)(?:phone|tel|call|fax|mobile|mail|contact|card|visa|account|iban|address|ip|host|server|telefon|konto|karte|carte|correo|tarjeta|cuenta|téléphone)[^\\p{L}]{0,6}$"
#: Words that announce a number of a person, as whole words; of the same list.
NUMBER_CUES = "(?i)(?<!\\p{L})(?:phone|tel|call|fax|mobile|contact|card|visa|account|telefon|konto|karte|carte|tarjeta|cuenta|téléphone)[^\\p{L}]{0,6}$"
#: Where selected spans overlap, the generator of the stricter form wins.
FIRST = ("digits", "dialled", "account", "address", "mailbox", "number")
#: Patterns that are learned from at most, the most frequent ones; all proposals are scored.
MAX_PATTERNS = 100_000
PRECISION, SUPPORT = 0.98, 20
TREES, DEPTH = 16, 3


def _mod97(x: Column) -> Column:
    """The check of an account number: 15 to 34 characters, remainder 1 with the first four moved to the end."""
    plain = F.translate(x, " ", "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4))), "")
    rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def _ipv6(x: Column) -> Column:
    groups = F.size(F.filter(F.split(x, ":"), lambda g: g != ""))
    return ~x.contains(".") & F.when(x.contains("::"), groups <= 7).otherwise(groups == 8)


def refuted(s: Column) -> Column:
    """Whether a proposal has as many digits as a card and their check fails."""
    return s["kind"].isin("number", "digits") & F.length(digits(s["value"])).between(14, 19) & ~_card(s["value"])


def weak(s: Column) -> Column:
    """Whether a proposal is an example of its generator's format by a check that no base pattern makes."""
    x = s["value"]
    return (
        F.when(s["kind"] == "account", _mod97(x))
        .when(s["kind"] == "address", _ipv6(x))
        .when(s["kind"] == "mailbox", x.rlike("(?i)[\\[(](?:at|dot)[\\])]") & x.rlike("[A-Za-z]{2}$"))
        .when(s["kind"] == "digits", _card(x))
        .when(s["kind"] == "dialled", F.length(digits(x)).between(10, 15))
        .otherwise(s["before"].rlike(NUMBER_CUES) & ~refuted(s))
    )


def _bucket(x: Column, *edges: int) -> Column:
    """0 below the first edge, 1 below the second, and so on."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(x < edges[i], F.lit(i)).otherwise(out)
    return out


def features(s: Column) -> list[Column]:
    """Small categories of one proposed span."""
    x, d = s["value"], digits(s["value"])
    side = lambda c: F.when(c == "", 0).when(c.rlike("^\\s$"), 1).when(c.rlike("^[\\p{L}\\p{N}_]$"), 2).otherwise(3)
    return [
        s["no"] - len(BASE),
        _bucket(F.length(d), 1, 7, 10, 12, 14, 16, 20),
        _bucket(F.length(x) - F.length(d), 1, 3, 6),
        F.when(x.startswith("+"), 1).otherwise(0),
        _bucket(F.length(x) - F.length(F.translate(x, ".", "")), 1, 2, 3),
        F.when(x.rlike("[@＠]"), 1).otherwise(0),
        side(F.right(s["before"], F.lit(1))),
        side(s["after"]),
        F.when(s["before"].rlike(NUMBER_CUES), 2).when(s["before"].rlike(CUES), 1).otherwise(0),
        F.when(x.rlike("[()\\[\\]]"), 1).when(x.rlike("[\\x20/-]"), 2).otherwise(0),
        F.when(x.rlike("[A-Za-z]"), 1).otherwise(0),
        F.when(x.contains("::"), 3).otherwise(_bucket(F.length(x) - F.length(F.translate(x, ":", "")), 1, 7)),
        F.when(refuted(s), 2).when(s["kind"].isin("number", "digits") & _card(x), 1).otherwise(0),
    ]


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row, written to the shared folder: ``keep``, __fits, __base and __proposed (start, stop, no, kind, label, weak, refuted, f).

    A hash of the text decides whether a row fits or calibrates, so copies stay on one side and no layout of files matters.
    """
    src = docs.select(*keep, (F.xxhash64(text) % 2 == 0).alias("__fits"), fenced(F.col(text)).alias("__clean"))
    base = src.withColumn("__found", find_all(F.col("__clean"), base=BASE, wide=PROPOSED)).select(*keep, "__fits", F.col("__found.base").alias("__base"), F.col("__found.wide").alias("__wide"))

    def look(grouped: Column) -> Column:
        one = lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), (s["no"] - len(BASE)).alias("no"), s["kind"].alias("kind"), touches(grouped, s).alias("label"), F.coalesce(weak(s), F.lit(False)).alias("weak"), F.coalesce(refuted(s), F.lit(False)).alias("refuted"), F.array(*[f.cast("int") for f in features(s)]).alias("f"))
        return F.transform("__wide", one)

    slim = F.transform("__base", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "stop", "no", "kind")]))
    return cut(base.select(*keep, "__fits", slim.alias("__base"), let(runs(F.col("__base")), look).alias("__proposed")), "pii")


def train(found: DataFrame):
    """(model, threshold by generator) of base likeness and of weak labels; half of the texts fit, half calibrate.

    Base likeness is learned without proposals that have a weak label alone, weak labels without those that cover a base
    span; only those of strict generators count there all the same.
    """
    strict = {i for i, f in enumerate(PROPOSED) if f.kind in STRICT}
    seen = found.select(F.col("__fits").alias("fits"), F.explode("__proposed").alias("p"))
    counts = seen.groupBy("fits", "p.f", "p.label", "p.weak").agg(F.count(F.lit(1)).alias("n"))
    counted = counts.orderBy(F.desc("n"), *counts.columns[:4]).limit(MAX_PATTERNS).collect()
    out = []
    for positive in ("label", "weak"):
        parts: dict[bool, dict[tuple, Pattern]] = {True: {}, False: {}}
        for r in counted:
            if r["label"] and r["f"][0] not in strict if positive == "weak" else r["weak"] and not r["label"]:
                continue
            p = parts[r["fits"]].setdefault(tuple(r["f"]), Pattern(tuple(r["f"]), 0, 0))
            p.rows, p.positives = p.rows + r["n"], p.positives + r["n"] * r[positive]
        model = fit(list(parts[True].values()), TREES, DEPTH)
        limits = {i: threshold(model, [p for p in parts[False].values() if p.values[0] == i], PRECISION, SUPPORT) for i in range(len(PROPOSED))}
        out.append((model, limits))
    return out


def selected(found: DataFrame) -> Column:
    """The proposals of a row that the trees select and no base span overlaps, nor each other; numbered after the base kinds."""
    models = [(model, limits) for model, limits in train(found) if any(map(isfinite, limits.values()))]
    if not models:
        return F.array().cast("array<struct<start:int,stop:int,no:int,kind:string>>")

    def passes(p: Column, model: Model, limits: dict[int, float]) -> Column:
        score, limit = model.sql(lambda i: p["f"][i]), F.lit(None).cast("double")
        for i, t in limits.items():
            if isfinite(t):
                limit = F.when(p["no"] == i, F.lit(t)).otherwise(limit)
        return F.coalesce(score >= limit - 1e-9, F.lit(False))

    usable = lambda p: ~p["label"] & ~p["refuted"] & reduce(lambda a, b: a | b, [passes(p, *m) for m in models])
    calibrated = {i for _, limits in models for i, t in limits.items() if isfinite(t)}
    order = [i for k in FIRST for i, f in enumerate(PROPOSED) if f.kind == k and i in calibrated]

    def kept(chosen: Column, before: Column, rest: list[int]) -> Column:
        """The chosen spans of the generators in order, each unless it touches what stays of those before it."""
        if not rest:
            return before
        free = lambda grouped: F.filter(chosen, lambda p: (p["no"] == rest[0]) & ~touches(grouped, p))
        return let(F.concat(before, let(runs(before), free)), lambda more: kept(chosen, more, rest[1:]))

    best = let(F.filter("__proposed", usable), lambda c: kept(c, F.filter(c, lambda p: p["no"] == order[0]), order[1:]))
    return F.transform(best, lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), (p["no"] + len(BASE)).alias("no"), p["kind"].alias("kind")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_selected.

    Null text is empty and has no spans; repeated rows and ids stay apart; other columns are ignored. Where the
    corpus has too few positives to calibrate a generator, it selects nothing. Empty in, empty out.
    """
    found = candidates(docs)
    more = selected(found)
    return found.select(
        "doc_id",
        *[many(F.col("__base"), f.kind).alias(f"n_{f.kind}") for f in BASE],
        F.sha2(joined(ordered(F.col("__base"))), 256).alias("base_sha256"),
        joined(ordered(F.concat("__base", more))).alias("spans"),
        F.size(more).cast("long").alias("n_selected"),
    )
