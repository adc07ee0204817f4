"""Preference formatting of conversations, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the layout: a turn is <|role|>\n, its text, and <|end|>\n.
OPEN, CLOSE = ("<|", "|>\n"), "<|end|>\n"


def escaped(said: Column) -> Column:
    """The text with a backslash more between < and | and between | and >, so that it holds no delimiter. One to one:
    taking one backslash out of each <\\| and |\\> gives the text back."""
    return F.regexp_replace(F.regexp_replace(said, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def _render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN[0]), t["role"], F.lit(OPEN[1]), t["text"], F.lit(CLOSE))))


def _spans(turns: Column) -> Column:
    """[start, end) of what is trained on, in characters of the rendered turns: the assistant's texts and their ends."""
    head = len("".join(OPEN))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.lit(head) + F.char_length(turn["role"])
        end = begin + F.char_length(turn["text"]) + F.lit(len(CLOSE))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(state["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def preferences(turns: DataFrame) -> DataFrame:
    """One row per pair of conversations: prompt, chosen and rejected, with what is trained on in each completion.

    turns: pair_id, side ('chosen' or 'rejected'), turn, role, text; other columns are left out. The prompt is the
    longest common prefix of turns (same role and text, in order of turn), rendered once; a completion is the rest of
    its side, and its mask has the spans [start, end) of the assistant's turns in it. Columns: pair_id, n_prompt_turns,
    n_chosen_turns, n_rejected_turns (turns after the prompt), prompt, chosen, rejected, chosen_mask, rejected_mask,
    complete (both sides have turns).

    Delimiters inside roles and texts are escaped (see escaped), so no text can end its turn or begin another.
    Null roles and texts are taken as empty, a null turn comes first; turns of equal number are ordered by role and
    text (escaped), and repeated rows are repeated turns. Rows with a null pair or another side are left out. A side without
    rows has an empty completion, and complete is false. An empty table gives an empty one. A row holds a pair whole,
    as the result does: one shuffle, by the pair.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, turn))).alias(s)
    pairs = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(side("chosen"), side("rejected"))
    c, r = F.col("chosen"), F.col("rejected")
    least = F.least(F.size(c), F.size(r))
    same = F.zip_with(F.slice(c, 1, least), F.slice(r, 1, least), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    differ = F.array_position(same, False)
    prefix = F.when(differ > 0, differ - 1).otherwise(least).cast("int")
    cut = pairs.withColumn("n", prefix)
    rest = lambda x: F.slice(F.col(x), F.col("n") + 1, F.size(x))
    cut = cut.select("pair_id", F.col("n").alias("n_prompt_turns"), F.slice("chosen", 1, F.col("n")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"), ((F.size("chosen") > 0) & (F.size("rejected") > 0)).alias("complete"))
    return cut.select(
        "pair_id", "n_prompt_turns", F.size("c").alias("n_chosen_turns"), F.size("r").alias("n_rejected_turns"),
        _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_mask"), _spans(F.col("r")).alias("rejected_mask"), "complete",
    )


def alternatives(conversations: DataFrame) -> DataFrame:
    """Turns for preferences() from plain conversations (conv_id, turn, role, text): a pair for each conversation.

    chosen is the conversation as it is. rejected has the same turns before the last assistant turn, and in that one's
    place the last assistant turn of the conversation beside it: 2n and 2n + 1 are beside each other. So both sides
    begin alike. A conversation without an assistant turn has no rejected side; where the one beside it has none, or is
    not there, the rejected side ends before the reply. Turns are ordered by number (null first), role and text, null
    roles and texts are empty, and repeated rows are repeated turns. Rows with a null conv_id are left out.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("pair_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0)))
    talks = talks.withColumn("n", last)
    replies = talks.where("n > 0").select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("beside"), F.element_at("turns", F.col("n"))["text"].alias("reply"))
    both = talks.join(replies, F.col("pair_id") == F.col("beside"), "left")
    row = lambda side, i, t: F.struct(F.lit(side).alias("side"), i.cast("long").alias("turn"), t["role"].alias("role"), t["text"].alias("text"))
    chosen = F.transform("turns", lambda t, i: row("chosen", i, t))
    before = F.transform(F.slice("turns", 1, F.greatest(F.col("n") - 1, F.lit(0))), lambda t, i: row("rejected", i, t))
    other = F.array(F.struct(F.lit("rejected").alias("side"), (F.col("n") - 1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text")))
    rejected = F.when(F.col("reply").isNotNull() & (F.col("n") > 0), F.concat(before, other)).otherwise(before)
    return both.select("pair_id", F.explode(F.concat(chosen, rejected)).alias("t")).select("pair_id", "t.*")
