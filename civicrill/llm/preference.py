"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The turns that both conversations share from the start are rendered once as the prompt; what follows is rendered
as the two completions, with the spans on which a loss is taken (the text and end mark of assistant turns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: What stands in a turn's own role and text for the marks' beginning, so that no text can forge a turn.
INERT = "< |"
TRAINED_ROLE = "assistant"


def _own(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit(OPEN), F.lit(INERT))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _own(t["role"]), F.lit(CLOSE))


def _body(t: Column) -> Column:
    return F.concat(_own(t["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def loss_spans(turns: Column) -> Column:
    """start:stop (code points of the rendered turns, comma-joined) of what assistant turns say, end marks included."""

    def step(s: Column, t: Column) -> Column:
        start = s["pos"] + F.length(_head(t))
        stop = start + F.length(_body(t))
        span = F.concat_ws(":", start.cast("string"), stop.cast("string"))
        return F.struct(stop.alias("pos"), F.when(t["role"] == TRAINED_ROLE, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")), step, lambda s: s["out"]), ",")


def _formatted(both: DataFrame) -> DataFrame:
    """pair_id and sorted turns a (chosen) and b (rejected) as prompt and completions."""
    same = F.zip_with(F.slice("a", F.lit(1), F.least(F.size("a"), F.size("b"))), F.slice("b", F.lit(1), F.least(F.size("a"), F.size("b"))), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    split = both.withColumn("n", F.coalesce(F.array_position(same, F.lit(False)), F.lit(0)).cast("int")).withColumn("n", F.when(F.col("n") == 0, F.least(F.size("a"), F.size("b"))).otherwise(F.col("n") - 1))
    rest = {x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0))) for x in "ab"}
    there = lambda x, c: F.when(F.size(x) > 0, c)
    return split.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        (F.size("a") - F.col("n")).cast("long").alias("n_chosen_turns"),
        (F.size("b") - F.col("n")).cast("long").alias("n_rejected_turns"),
        render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        there("a", render(rest["a"])).alias("chosen"),
        there("b", render(rest["b"])).alias("rejected"),
        there("a", loss_spans(rest["a"])).alias("chosen_loss"),
        there("b", loss_spans(rest["b"])).alias("rejected_loss"),
    )


def format_pairs(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, n_chosen_turns, n_rejected_turns, prompt, chosen, rejected, chosen_loss, rejected_loss.

    ``pair`` and ``chosen`` (boolean) are expressions over the columns conv_id, turn, role, text. Turns stand in the
    order of turn, role, text (nulls first); equal rows count as turns of their own. Turns are shared when role and
    text are equal, null equal to null; null renders as empty. A conversation without a partner keeps its row, with
    an empty prompt and a null other side. Rows without a pair or side (null conv_id) belong to no pair.
    """
    side = F.struct("turn", "role", "text")
    keyed = turns.select("turn", "role", "text", pair.alias("pair_id"), chosen.alias("is_chosen")).filter("pair_id is not null and is_chosen is not null")
    return _formatted(keyed.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("is_chosen"), side))).alias("a"), F.sort_array(F.collect_list(F.when(~F.col("is_chosen"), side))).alias("b")))


def neighbours(turns: DataFrame) -> DataFrame:
    """format_pairs() of a table that holds each chosen conversation at an even conv_id and its rejected one at the next."""
    return format_pairs(turns, F.floor(F.col("conv_id") / 2), F.pmod(F.col("conv_id"), F.lit(2)) == 0)


def earlier_answers(turns: DataFrame) -> DataFrame:
    """Pairs out of a table of plain conversations: the last answer is preferred to the answer before it in its place.

    The chosen conversation ends with its last assistant turn, the rejected one has the text of the assistant turn before
    there; what leads up to it is the prompt. pair_id is conv_id; the columns, the order of turns and the treatment of nulls
    are those of format_pairs(). A conversation of fewer than two assistant turns has no rejected side: it keeps its row, whole,
    with an empty prompt.
    """
    side = F.struct("turn", "role", "text")
    own = turns.filter("conv_id is not null").groupBy(F.col("conv_id").alias("pair_id")).agg(F.sort_array(F.collect_list(side)).alias("t"))
    places = F.filter(F.transform("t", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i)), lambda i: i.isNotNull())
    found = own.withColumn("at", places).withColumn("pairs", F.size("at") > 1)
    last, before = F.element_at("at", -1), F.element_at("at", -2)
    instead = F.struct(F.col("t")[last]["turn"].alias("turn"), F.col("t")[last]["role"].alias("role"), F.col("t")[before]["text"].alias("text"))
    none = F.slice("t", F.lit(1), F.lit(0))
    a = F.when(F.col("pairs"), F.slice("t", F.lit(1), last + 1)).otherwise(F.col("t"))
    b = F.when(F.col("pairs"), F.concat(F.slice("t", F.lit(1), last), F.array(instead))).otherwise(none)
    return _formatted(found.select("pair_id", a.alias("a"), b.alias("b")))


#: The same for earlier_answers() in SQL.
_RENDER = "array_to_string(list_transform({0}, lambda z: '<|' || replace(coalesce(z.role, ''), '<|', '< |') || '|>' || chr(10) || replace(coalesce(z.text, ''), '<|', '< |') || '<|end|>' || chr(10)), '')"
_BODY = "replace(coalesce({0}, ''), '<|', '< |') || '<|end|>' || chr(10)"
_HEAD = "'<|assistant|>' || chr(10)"
EARLIER_ANSWERS = f"""WITH c AS (SELECT conv_id AS pair_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
p AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: coalesce(t[i].role = 'assistant', false)) AS said FROM c),
s AS (SELECT *, len(said) > 1 AS pairs, said[-1] AS final, t[said[-1]].text AS x, t[said[-2]].text AS y FROM p),
d AS (SELECT *, pairs AND x IS NOT DISTINCT FROM y AS same FROM s)
SELECT pair_id, CAST(CASE WHEN NOT pairs THEN 0 WHEN same THEN final ELSE final - 1 END AS BIGINT) AS n_prompt_turns, CAST(CASE WHEN NOT pairs THEN len(t) WHEN same THEN 0 ELSE 1 END AS BIGINT) AS n_chosen_turns, CAST(CASE WHEN NOT pairs OR same THEN 0 ELSE 1 END AS BIGINT) AS n_rejected_turns,
 CASE WHEN NOT pairs THEN '' ELSE {_RENDER.format("t[1:CASE WHEN same THEN final ELSE final - 1 END]")} END AS prompt,
 CASE WHEN NOT pairs THEN {_RENDER.format("t")} WHEN same THEN '' ELSE {_HEAD} || {_BODY.format("x")} END AS chosen,
 CASE WHEN NOT pairs THEN NULL WHEN same THEN '' ELSE {_HEAD} || {_BODY.format("y")} END AS rejected,
 CASE WHEN NOT pairs THEN CASE WHEN len(said) = 0 THEN '' ELSE length({_RENDER.format("t[1:final - 1]")} || {_HEAD}) || ':' || length({_RENDER.format("t[1:final]")}) END WHEN same THEN '' ELSE length({_HEAD}) || ':' || length({_HEAD} || {_BODY.format("x")}) END AS chosen_loss,
 CASE WHEN NOT pairs THEN NULL WHEN same THEN '' ELSE length({_HEAD}) || ':' || length({_HEAD} || {_BODY.format("y")}) END AS rejected_loss FROM d"""
