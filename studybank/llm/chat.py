"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; the rest of either
conversation is its completion, with the character spans that a loss may use (what
the assistant says and its end mark).  Native expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: ``key`` and its turns in order, array of (role, text).

    Repeated rows count once; turns of one number go by role, then text; null turn numbers
    come first.  Rows with a null key form one conversation."""
    one = turns.select(key, "turn", "role", "text").distinct()
    return one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all")).select(
        key, F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _line(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"),
                    F.coalesce(t["text"], F.lit("")), F.lit(CLOSE + "\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _line), "")


def _spans(turns: Column) -> Column:
    """(start, end) of what an assistant says, with its end mark, in the rendered turns."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        end = acc["at"] + F.char_length(_line(t))
        lead = F.lit(len(OPEN) + 1) + F.char_length(F.coalesce(t["role"], F.lit("")))
        span = F.struct((acc["at"] + lead).alias("start"), (end - 1).alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, begin, step, lambda acc: acc["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """Paired completions of ``chosen`` and ``rejected`` (``key``, turns), joined on ``key``.

    Returns key, n_common (turns of the prompt), prompt, chosen, rejected, chosen_spans and
    rejected_spans: character spans, [start, end) in the completion, that carry loss.
    Turns are equal if role and text are, null equal to null.  A conversation that is a
    prefix of the other has an empty completion.  Keys that only one side has give no pair;
    null keys meet each other."""
    r = rejected.select(F.col(key).alias("_key"), F.col("turns").alias("_other"))
    both = chosen.select(key, F.col("turns").alias("_turns")).join(r, F.col(key).eqNullSafe(F.col("_key")))
    same = F.zip_with("_turns", "_other", lambda a, b: a.isNotNull() & b.isNotNull() & a.eqNullSafe(b))
    n = F.array_position(same, False).cast("int")
    both = both.withColumn("n_common", F.when(n > 0, n - 1).otherwise(F.size("_turns")))

    def rest(c):
        return F.slice(F.col(c), F.col("n_common") + 1, F.size(c))

    return both.select(
        key, "n_common", _render(F.slice("_turns", F.lit(1), F.col("n_common"))).alias("prompt"),
        _render(rest("_turns")).alias("chosen"), _render(rest("_other")).alias("rejected"),
        _spans(rest("_turns")).alias("chosen_spans"), _spans(rest("_other")).alias("rejected_spans"))


def with_swapped_answer(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rejected partners for ``convs``: each conversation with its last assistant text replaced
    by that of the conversation whose key differs in the lowest bit.

    Without such a partner, or without an assistant turn on either side, that last turn is
    left out; a conversation without an assistant turn stays as it is."""
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    ends = convs.withColumn("_last", F.when(F.size(said) > 0, F.element_at(said, -1)["text"]))
    other = (ends.filter(F.col("_last").isNotNull() & F.col(key).isNotNull())
             .select(F.col(key).bitwiseXOR(F.lit(1)).alias("_pair"), F.col("_last").alias("_said")))
    at = F.array_position(F.reverse(F.transform("turns", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))), True)
    got = convs.withColumn("_at", F.when(at > 0, F.size("turns") - at.cast("int") + 1)).join(
        other, F.col(key) == F.col("_pair"), "left")
    swapped = F.filter(
        F.transform("turns", lambda t, i: F.struct(
            t["role"].alias("role"), F.when(i + 1 == F.col("_at"), F.col("_said")).otherwise(t["text"]).alias("text"))),
        lambda t, i: F.col("_at").isNull() | F.col("_said").isNotNull() | (i + 1 != F.col("_at")))
    return got.select(key, swapped.alias("turns"))
