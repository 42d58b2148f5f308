"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled, twice where a source is to give more than it has, and
pass one behind the other: a document's virtual finish time is the source's words up to its
end divided by the source's target. All documents of all sources are ordered by that time,
in ranges of it, and the order is cut where the budget is spent. A document that its
source's target ends in is served up to there.

Sources in code point order, null last, weigh `weights`, repeating, and share `budget` times
all sizes. No target exceeds `most` times its source's size: the excess is shared again by
weight, until none is above. That level is found in one pass over the sources in order of
size by weight, from running sums.

Defined cases: a size is the number of words, 0 for a null or wordless text, of which nothing
is taken; a null source is a source; rows with a null or repeated id are documents of their
own; ties of the shuffle go by id, then by row, so that reruns agree; an empty table gives
an empty table; columns other than the named don't matter, whatever they are called.

Scale: texts are read once, for their sizes; what moves are narrow rows. All queues, one
source's after the other's, are one order in even ranges, and the ranges' totals are what
each starts from; so is the order of virtual time. A hot source's rows are salted where they
meet its target. No task sees a whole source, and no source's size matters.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcflow.operators.layout import running_sums
from arcflow.plans.cut import cut
from arcflow.plans.spread import join_counted

WEIGHTS = (5, 2, 1)
#: The mix's words, by all sizes; a document's words at most, by its size.
BUDGET = 1.5
MOST = 2
SEED = 42

def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, name, size) of every row; `name` is the source, without nulls."""
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("name"), count.alias("size")).withColumn("row", F.monotonically_increasing_id())


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, name, source_size, documents, weight, target) of each source of rows (source, name, size)."""
    if not 0 <= budget <= most:
        raise ValueError("the budget must be between none and `most` times all sizes")
    found = rows.groupBy("source", "name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    named = running_sums(found.withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long")), ["last", "name"], "one", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    weighed = named.select("source", "name", "source_size", "documents", weight.alias("weight"))
    # Sources whose size by weight is smaller have their own limit before the others.
    room = F.col("source_size") * (F.lit(lcm(*weights)) / F.col("weight")).cast("long")
    ordered = running_sums(weighed.withColumn("room", room), ["room", "name"], "source_size", "size_before")
    ordered = cut(running_sums(ordered, ["room", "name"], "weight", "weight_before"))
    whole = ordered.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if whole["size"] is None:
        return ordered.select("source", "name", "source_size", "documents", "weight", F.lit(0.0).alias("target"))
    left = F.lit(budget * whole["size"]) - most * F.col("size_before")
    among = F.lit(whole["weight"]) - F.col("weight_before")
    level = ordered.where(left * F.col("weight") <= most * F.col("source_size").cast("double") * among).select(left.alias("left"), among.alias("among"), "room", "name").orderBy("room", "name").first()
    share = F.lit(level["left"]) * F.col("weight") / F.lit(level["among"])
    above = (F.col("room") < level["room"]) | ((F.col("room") == level["room"]) & (F.col("name") < level["name"]))
    return ordered.select("source", "name", "source_size", "documents", "weight", F.when(above, (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def served(rows: DataFrame, shares: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(row, doc_id, name, size, source_size, target, copy, key, words, finish): each document's turns in its source's queue, the words served and the virtual time at their end.

    `rows` are those of `sizes`, written; a turn after the target is spent has no words and no time."""
    turns = rows.select("row", "doc_id", "name", "size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy"))
    turns = turns.withColumn("key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "copy", "doc_id")), 1, 15), 16, 10).cast("long"))
    ordered = running_sums(turns, ["name", "copy", "key", "doc_id", "size", "row"], "size", "at")
    first = running_sums(shares.withColumn("all", most * F.col("source_size")), ["name"], "all", "first")
    queued = join_counted(ordered, cut(first.select("name", "source_size", "target", "first", (most * F.col("documents")).alias("turns"))), ["name"], "turns", ["row"])
    before = F.col("at") - F.col("first")
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.ceil("target") - before)).cast("long")
    finish = F.when(words > 0, F.least(F.lit(1.0), (before + words) / F.col("target")))
    return queued.select("row", "doc_id", "name", "size", "source_size", "target", "copy", "key", words.alias("words"), finish.alias("finish"))


def in_order(turns: DataFrame, budget: int) -> DataFrame:
    """Turns with words, with `position`, the words before them in the mix, and `taken`, their words up to the budget; range-sorted by virtual time."""
    ordered = running_sums(turns.where("words > 0"), ["finish", "name", "copy", "key", "doc_id", "size", "row"], "words", "position")
    return ordered.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("position"))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(row, doc_id, name, size, source_size, target, copy, key, words, finish, position, taken): every row's turns; those without words have no position."""
    rows = cut(sizes(docs, id_col, text_col, source_col))
    shares = cut(targets(rows, weights, budget, most))
    turns = cut(served(rows, shares, most, seed))
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    idle = turns.where("words = 0").withColumn("position", F.lit(None).cast("long")).withColumn("taken", F.lit(0).cast("long"))
    return in_order(turns, int(budget * total)).unionByName(idle)


def taken_words(mixed: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document of `mix`, over its turns."""
    return mixed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).drop("row")
