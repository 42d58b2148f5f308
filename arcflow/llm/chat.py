"""Preference formatting of chat conversations, with DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is rendered once
as the prompt; what follows in each is rendered as its completion. A turn is
`<|role|>`, a line feed, its text, `<|end|>` and a line feed. A completion's mask lists
the ranges (code points, end exclusive) that are trained on: text and end mark of
assistant turns. Turns are equal if role and text are.

Defined cases: a null role or text counts as empty; null conversations have no turns; if
one conversation is a prefix of the other its completion is empty; equal conversations
have two empty completions; turns are in order of number, role and text (null numbers
first), and repeated rows count once; other columns are ignored; empty tables give none.
A text or role is written as it is, whatever marks it holds: where turns begin is told by
the turns and masks, not by searching the rendered text, and masks are as long as the text.

Scale: one aggregation by conversation id, whose rows are one example and so stay
together; all else is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
ASSISTANT = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns array<struct<role, text>>) in order."""
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(id_col).alias(id_col)).agg(F.array_sort(F.collect_set(row)).alias("turns"))
    return grouped.select(id_col, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turn: Column) -> Column:
    return F.concat(_header(turn), turn["text"], F.lit("<|end|>\n"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns in which two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    equal = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, i).eqNullSafe(F.get(b, i)))
    first = F.array_position(equal, False).cast("int")
    return F.when(n == 0, 0).when(first > 0, first - 1).otherwise(n)


def _mask(turns: Column) -> Column:
    """Trained ranges of rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def add(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.length(_header(turn))
        end = done["at"] + F.length(render(turn)) - 1
        own = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(turn["role"] == ASSISTANT, F.concat(done["spans"], own)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda done: done["spans"])


def format_preferences(pairs: DataFrame, id_col: str, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """One row per pair of conversations (arrays of role and text): its id, prompt_turns, prompt, and for each side text, mask and turns."""
    turns = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(f"array<{TURN}>")), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = pairs.select(F.col(id_col).alias("id"), turns(chosen_col).alias("c"), turns(rejected_col).alias("r")).withColumn("n", common_prefix(F.col("c"), F.col("r")))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c) - F.col("n"))
    rows = rows.select("id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    text = lambda c: F.array_join(F.transform(c, render), "")
    return rows.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("prompt_turns"), text("p").alias("prompt"),
        text("c").alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), F.size("c").cast("long").alias("chosen_turns"),
        text("r").alias("rejected"), _mask(F.col("r")).alias("rejected_mask"), F.size("r").cast("long").alias("rejected_turns"),
    )


def echo_pairs(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs from conversations without judgements: chosen is the conversation; rejected branches off at one of its
    assistant turns (the id modulo their number), where the turn before is repeated as the answer, and ends there.
    Conversations without an assistant turn or an id give no pair."""
    rows = conversations(turns, id_col).where(F.col(id_col).isNotNull())
    places = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get(F.col("turns"), i)["role"] == ASSISTANT)
    rows = rows.withColumn("places", places).where(F.size("places") > 0)
    at = F.get("places", F.pmod(F.col(id_col), F.size("places")).cast("int"))
    rows = rows.withColumn("at", at)
    echo = F.array(F.struct(F.lit(ASSISTANT).alias("role"), F.coalesce(F.get("turns", F.col("at") - 1)["text"], F.lit("")).alias("text")))
    return rows.select(id_col, F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("at")), echo).alias("rejected"))
