"""Preference pairs from conversations: one prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What opens a turn's role, closes it, and ends the turn.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>"


def _clean(text: Column) -> Column:
    """Text that cannot be taken for a marker; null counts as empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END + "\n"))), "")


def _mask(turns: Column) -> Column:
    """The (from, to) characters of a rendered completion that a model is trained on: what assistants say, and the end."""
    kind = "struct<at: int, spans: array<struct<from: int, to: int>>>"
    head = lambda t: F.length(t["role"]) + len(OPEN + CLOSE)
    body = lambda t: F.length(t["text"]) + len(END)

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head(t)
        span = F.struct(begin.alias("from"), (begin + body(t)).alias("to"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((begin + body(t) + 1).alias("at"), spans.alias("spans")).cast(kind)

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(kind), add, lambda a: a["spans"])


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair of a chosen and a rejected conversation.

    ``turns`` has ``pair_id, chosen (boolean), turn, role, text``. The prompt is
    the longest run of first turns that both conversations share (role and text),
    rendered once; ``chosen`` and ``rejected`` render what is left of each, and
    the masks are the character spans of those completions to train on. Returns
    ``pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask,
    rejected_mask``.

    Turns go by number; equal numbers by role and text; repeated rows count once.
    A null role is "unknown", a null text empty, a null number first; null pairs
    are left out. A side without turns, or one that is a prefix of the other, has
    an empty completion and mask. Markers inside texts are broken by a space. An
    empty table gives no rows; other columns are not read. A conversation is one
    string in the end, so it is gathered into one row; pairs never are.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), _clean(F.col("text")).alias("text"))
    side = lambda which: F.array_sort(F.collect_set(F.when(F.col("chosen") == F.lit(which), turn)))
    pairs = turns.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(side(True).alias("_c"), side(False).alias("_r"))
    same = F.transform(F.arrays_zip("_c", "_r"), lambda x: F.coalesce((x["_c"]["role"] == x["_r"]["role"]) & (x["_c"]["text"] == x["_r"]["text"]), F.lit(False)))
    differ = F.array_position(same, False).cast("int")
    pairs = pairs.withColumn("n_prompt_turns", F.when(differ > 0, differ - 1).otherwise(F.size("_c")))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    pairs = pairs.withColumns({"_p": F.slice("_c", F.lit(1), F.col("n_prompt_turns")), "_c": rest("_c"), "_r": rest("_r")})
    return pairs.select("pair_id", "n_prompt_turns", _rendered(F.col("_p")).alias("prompt"), _rendered(F.col("_c")).alias("chosen"), _rendered(F.col("_r")).alias("rejected"), _mask(F.col("_c")).alias("chosen_mask"), _mask(F.col("_r")).alias("rejected_mask"))


def mismatched_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs for ``format_pairs`` from plain conversations (``conv_id, turn, role, text``).

    Chosen is a conversation up to its last assistant turn; rejected is the same
    up to that turn, which is replaced by the last assistant turn of the
    conversation whose id differs in the lowest bit, if it has one. Conversations
    without an assistant turn give no pair.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order))
    last = rows.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("pos", "text")).alias("last"))
    known = rows.join(last, "conv_id")
    chosen = known.filter(F.col("pos") <= F.col("last.pos")).select(F.col("conv_id").alias("pair_id"), F.lit(True).alias("chosen"), F.col("pos").alias("turn"), "role", "text")
    kept = known.filter(F.col("pos") < F.col("last.pos")).select(F.col("conv_id").alias("pair_id"), F.lit(False).alias("chosen"), F.col("pos").alias("turn"), "role", "text")
    reply = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("partner"), F.col("last.text").alias("text"))
    other = last.join(reply, last["conv_id"] == reply["partner"]).select(F.col("conv_id").alias("pair_id"), F.lit(False).alias("chosen"), F.col("last.pos").alias("turn"), F.lit("assistant").alias("role"), "text")
    return chosen.unionByName(kept).unionByName(other)
