"""Audit of quality filters: what each removes in every order of applying them, and what it adds to the others.

A relational word pipeline: the words of every text are exploded, aggregated by document and
word and then by document, for its words and distinct words; the flags of the other filters
are outer-joined, as texts without words aren't among the exploded. A document's flags are
one of 32 combinations, and each part of the corpus is aggregated to a count for each
combination. All orders of the filters follow from these 32 counts.

The filters, by letter: A: under 200 words; B: distinct words are under half of all;
C: over 2 % of the code points are A-Z; D: holds any of ``#$%&*|``; E: a smaller id has
the same text (by SHA-256). Words are maximal runs without space and controls from tab to
carriage return, and differ by case.

Defined cases: a null text is empty, and has no words; empty texts are the same text; a null
id is smaller than none, so that such a row neither fails nor causes E, and has no labels;
repeated rows count each, and don't fail E because of each other; of repeated labels of one
id the highest counts; a null part is an empty string; an empty table has no parts; columns
other than the named are ignored, whatever they are called.

Scale: one exchange of the texts, by document, in which the words are then aggregated without
another; a document is a row, so that copies are spread. Copies of a text meet by its digest,
salted; parts are partial sums of at most 32 rows a task each. Texts of any length are read whole.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcflow.plans.cut import cut
from arcflow.plans.spread import join_counted

FILTERS = "ABCDE"
#: Pattern of what separates words.
SPACE = r"[\x20\x09-\x0D]+"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, words, distinct_words) of each document with words; rows of one id and text are one document."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("text is not null")
    whole = keyed.groupBy("id", "text_hash").agg(F.first("text").alias("text"))
    words = whole.select("id", "text_hash", F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    each = words.groupBy("id", "text_hash", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("id", "text_hash").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words"))


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, rows): documents of one id, text and part, the filters that they fail (bit k for the k-th), and how many rows they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    flags = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"), (100 * capitals > 2 * F.length(text)).alias("c"), text.rlike(r"[#$%&*|]").alias("d"),
    )
    flags = cut(flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("rows")))
    same = cut(flags.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    told = join_counted(flags, same, ["digest"], "n", ["id", "text_hash", "part"])
    counted = word_counts(docs, id_col, text_col)
    known = told.alias("f").join(counted.alias("w"), F.col("f.id").eqNullSafe(F.col("w.id")) & (F.col("f.text_hash") == F.col("w.text_hash")), "left")
    words, distinct = F.coalesce("w.words", F.lit(0)), F.coalesce("w.distinct_words", F.lit(0))
    fails = (words < 200, 100 * distinct < 50 * words, F.col("f.c"), F.col("f.d"), F.coalesce(F.col("f.id") > F.col("f.least"), F.lit(False)))
    mask = reduce(lambda a, b: a + b, (F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)))
    return known.select("f.id", "f.part", mask.alias("mask"), "f.rows")


def combination_counts(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, n_0 .. n_31, good_0 .. good_31, toxic_0 .. toxic_31): documents of each part for each combination of failed filters, all, good and toxic."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(good_col).alias("good"), F.max(toxic_col).alias("toxic"))
    # Rows without an id meet no label, and so needn't all go to one task.
    nameless = flags.where("id is null").select("part", "mask", "rows", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    known = flags.where("id is not null").join(marks, "id", "left").select("part", "mask", "rows", "good", "toxic").unionByName(nameless)
    kinds = {"n": F.col("rows"), "good": F.when(F.col("good") == 1, F.col("rows")), "toxic": F.when(F.col("toxic") == 1, F.col("rows"))}
    summed = known.groupBy("part", "mask").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(k) for k, x in kinds.items()))
    return summed.groupBy("part").agg(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(k))), F.lit(0)).alias(f"{k}_{m}") for k in kinds for m in range(1 << len(FILTERS))))


def all_orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Shapley sums what the step's filter removes over all orders: of documents that fail k filters, each of these is the first in a k-th of the orders."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            steps.append((name, step, 1 << k, before))
            before |= 1 << k
    orders = len(steps) // len(FILTERS)
    masks = range(1 << len(FILTERS))
    arrays = counts.select("part", *(F.array(*(f"{k}_{m}" for m in masks)).alias(k) for k in ("n", "good", "toxic")))
    plan = F.array(*(F.struct(F.lit(name).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for name, step, bit, before in steps))
    rows = arrays.withColumn("_plan", F.explode(plan)).select("part", "n", "good", "toxic", "_plan.*")

    def total(column: str, keep: str, weight: Column | str = "1") -> Column:
        return F.expr(f"aggregate(sequence(0, {len(masks) - 1}), 0L, (s, m) -> s + case when {keep} then {column}[m] * {weight} else 0L end)")

    hit, free = "(m & bit) <> 0", "(m & before) = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("n", f"{free} and not {hit}").alias("kept"), total("n", f"{free} and {hit}").alias("removed"),
        total("n", f"{hit} and not {free}").alias("redundant"), total("n", "m = bit").alias("unique_fails"),
        total("good", f"{free} and {hit}").alias("good_lost"), total("toxic", f"{free} and {hit}").alias("toxic_lost"),
        total("n", hit, f"({orders} div greatest(bit_count(m), 1))").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """`all_orders` of the five filters over whole documents."""
    return all_orders(cut(combination_counts(flagged(docs, id_col, text_col, part_col), labels, id_col, good_col, toxic_col)))
