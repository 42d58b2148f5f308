"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcflow.plans.cut import cut, few
from arcflow.plans.spread import hot_keys, join_salted, salts_of

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): component is the smallest node reachable.

    Loops, repeated edges and edges with a null end don't matter. Edges are kept as (greater, smaller).
    Large-star: every greater neighbour of a node moves to the smallest of its neighbourhood. Small-star:
    a node's smaller neighbours and the node itself move to the smallest of them. Rounds end when every
    node with a smaller neighbour has no other. Each round is cut, so that a lost executor costs no more.
    Minima are partial sums; the rows of hubs are salted where they meet them (see `join_salted`). A node's
    smaller neighbours after large-star are no more than its neighbours before, so the same salts serve both.
    Edges are counted first, so that a round on few of them has few tasks and files. Salts keep tasks even.
    """
    current = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = 2 * current.count()
    current = few(current, n)
    for _ in range(MAX_ROUNDS):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        least = cut(few(least, n))
        look = least.agg(F.count_if(F.expr("m < a and n > 1")).alias("open"), F.sum("n").alias("total"), F.max("n").alias("most")).first()
        if not look["open"]:
            break
        n = look["total"]
        hot, limit = hot_keys(least, "a", "n", n, look["most"])
        salts = salts_of(hot, limit, "a")
        meet = lambda rows, single: join_salted(rows, single, ["a"], salts, ["b"]) if hot else rows.join(single, "a")  # noqa: B023, E731
        large = few(few(meet(both, least.select("a", F.least("a", "m").alias("m"))), n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), n)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = few(meet(large, least), n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = cut(few(moved.union(few(least.select("a", F.col("m").alias("b")), n)).distinct(), n))
    else:
        raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
