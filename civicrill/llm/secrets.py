"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every candidate's value is hashed and counted by distinct repositories and owners over the whole corpus. A
value that many owners carry, or that very many repositories of several owners carry, is a widely copied example; any
other value looks live. Base candidates are always reported; candidates of the method's own, wider patterns are reported when they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicrill.llm.common import ROW, cut, numbered
from civicrill.llm.spans import Finder, fenced, find_all, holds, joined, many, masked, ordered

#: A value is an example if so many owners carry it, or if more than one owner and so many repositories do; else it looks live.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 8
#: A value of so many occurrences is joined without a shuffle. There is at most one such value for each HOT candidates.
HOT = 100_000
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (
    Finder("assign", ASSIGN, lambda x: F.length(F.regexp_extract(x, ASSIGN, 1)) >= 6, lambda x: F.regexp_extract(x, ASSIGN, 1), hint=holds("=", ":")),
    Finder("access", "AKIA[A-Z0-9]{16,}+", hint=holds("AKIA")),
    Finder("hex", "[0-9a-f]{24,}+"),
)
WIDER = (
    Finder("signed", "eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+", hint=holds("eyJ")),
    Finder("vendor", "(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35,}+)", hint=holds("gh", "xox", "sk_live_", "AIza")),
    Finder("private", "-----BEGIN [A-Z\\x20]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\\s]{64,}+", hint=holds("-----BEGIN ")),
)
MASK = "[SECRET]"
ALL = "array<struct<start:int,stop:int,no:int,kind:string,n_repos:bigint,n_owners:bigint,live:boolean>>"


def with_spans(src: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with __base and __wider, the spans of a text with their values as digests."""
    slim = lambda spans: F.transform(spans, lambda s: s.withField("value", F.sha2(s["value"], 256)).dropFields("before", "after"))
    found = src.withColumn("__clean", fenced(F.col(text))).withColumn("__found", find_all(F.col("__clean"), base=BASE, wider=WIDER))
    return found.select(*keep, slim(F.col("__found.base")).alias("__base"), slim(F.col("__found.wider")).alias("__wider"))


def candidates(docs: DataFrame, repo: Column, owner: Column, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per input row, written to the shared folder: ROW, ``keep``, __repo, __owner, __base and __wider spans."""
    src = numbered(docs).select(ROW, *keep, repo.cast("string").alias("__repo"), owner.cast("string").alias("__owner"), F.col(text).alias("__text"))
    return cut(with_spans(src, "__text", [ROW, *keep, "__repo", "__owner"]), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n, n_repos, n_owners of every candidate value; hot values fold before each shuffle. A null repository counts as one."""
    each = found.select("__owner", "__repo", F.explode(F.concat("__base", "__wider")).alias("s")).groupBy(F.col("s.value").alias("hash"), "__owner", "__repo").agg(F.count(F.lit(1)).alias("n"))
    owned = each.groupBy("hash", "__owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return owned.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def verdicts(found: DataFrame) -> DataFrame:
    """ROW and __all, the spans of each row that has any, with n_repos, n_owners and whether they look live.

    A value of HOT occurrences meets its counts by broadcast, the others by a shuffle on the value, in which no key is hot.
    """
    owned = cut(ownership(found), "secrets-owned")
    each = found.filter(F.size("__base") + F.size("__wider") > 0).select(ROW, F.explode(F.concat("__base", "__wider")).alias("s")).withColumn("hash", F.col("s.value"))
    live = F.when(F.col("n_owners") >= EXAMPLE_OWNERS, False).otherwise((F.col("n_owners") == 1) | (F.col("n_repos") < EXAMPLE_REPOS))
    hot = owned.filter(F.col("n") >= HOT).select("hash", live.alias("hot_live"), F.col("n_repos").alias("hot_repos"), F.col("n_owners").alias("hot_owners"))
    cold = owned.filter(F.col("n") < HOT).select("hash", live.alias("cold_live"), F.col("n_repos").alias("cold_repos"), F.col("n_owners").alias("cold_owners"))
    first = each.join(F.broadcast(hot), "hash", "left")
    # what is hot goes on under keys of its own, which the shuffle spreads
    spread = first.withColumn("hash", F.when(F.col("hot_owners").isNotNull(), F.concat(F.lit("hot-"), F.col(ROW).cast("string"))).otherwise(F.col("hash")))
    both = {c: F.coalesce(f"hot_{c}", f"cold_{c}").alias(f"n_{c}" if c != "live" else c) for c in ("repos", "owners", "live")}
    return spread.join(cold, "hash", "left").groupBy(ROW).agg(F.collect_list(F.struct("s.start", "s.stop", "s.no", "s.kind", *both.values())).alias("__all"))


def scan(docs: DataFrame, repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples, most_repos, most_owners.

    ``repo`` and ``owner`` default to the column source and its part before the first slash. Null text is empty and
    has no spans; a null source counts as one repository and owner; repeated rows and ids stay apart, other columns
    are ignored. Empty in, empty out.
    """
    repo = F.col("source") if repo is None else repo
    owner = F.substring_index(repo, "/", 1) if owner is None else owner
    found = candidates(docs, repo, owner)
    all_ = F.coalesce("__all", F.array().cast(ALL))
    judged = found.select(ROW, "doc_id", "__base").join(verdicts(found), ROW, "left").select("doc_id", "__base", all_.alias("__all"))
    live = F.filter("__all", lambda s: s["live"])
    shown = F.filter("__all", lambda s: (s["no"] < len(BASE)) | s["live"])
    most = lambda c: F.coalesce(F.array_max(F.transform("__all", lambda s: s[c])), F.lit(0)).cast("long").alias(f"most_{c[2:]}")
    return judged.select(
        "doc_id",
        *[many(F.col("__base"), f.kind).alias(f"n_{f.kind}") for f in BASE],
        F.sha2(joined(ordered(F.col("__base"))), 256).alias("base_sha256"),
        joined(ordered(shown)).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        (F.size("__all") - F.size(live)).cast("long").alias("n_examples"),
        most("n_repos"),
        most("n_owners"),
    )


def redact(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with live-looking values masked and, if there is one, the length column brought up to date. Examples stay.

    Texts are searched once, in a pass that writes them with their spans to the shared folder, those with and those
    without candidates apart. Only the former meet verdicts; the others are read back as they are.
    """
    repo = F.col("source") if repo is None else repo
    owner = F.substring_index(repo, "/", 1) if owner is None else owner
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, inner, strict=True))
    src = numbered(docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()], repo.cast("string").alias("__repo"), owner.cast("string").alias("__owner")))
    found = cut(with_spans(src, own[text], [ROW, *inner, "__repo", "__owner"]).withColumn("__some", F.size("__base") + F.size("__wider") > 0), "secrets", "__some")
    some, none = found.filter("__some"), found.filter("not __some")
    live = verdicts(some.select(ROW, "__repo", "__owner", "__base", "__wider")).select(ROW, ordered(F.filter("__all", lambda s: s["live"])).alias("__live")).filter(F.size("__live") > 0)
    # a name of its own: a select that replaces a column may take its new value for the old one in a lambda
    changed = some.join(live, ROW, "left").withColumn("__new", F.when(F.col("__live").isNotNull(), masked(F.col(own[text]), F.col("__live"), MASK)))
    new = {own[text]: F.coalesce("__new", own[text])}
    if length in own:
        new[own[length]] = F.coalesce(F.length("__new").cast(docs.schema[length].dataType), F.col(own[length]))
    return none.select(inner).union(changed.select(*[new.get(k, F.col(k)).alias(f"__o{i}") for i, k in enumerate(inner)])).toDF(*docs.columns)
