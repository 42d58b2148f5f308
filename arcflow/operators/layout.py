"""Offsets of compressed rows and columns, lookups and reports over ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcflow.graph import Graph
from arcflow.plans.cut import cut


def running_sums(rows: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """`rows` with the sum of a column over all rows before, by ranges of the order and the ranges' totals."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    totals = placed.groupBy("part").agg(F.sum(column).alias("n"))  # a row for each partition
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("base"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(column).over(within), F.lit(0))
    return placed.withColumn("inner", inner).join(F.broadcast(base), "part").select(*rows.columns, (F.col("base") + F.col("inner")).alias(name))


def running_offsets(degrees: DataFrame) -> DataFrame:
    """(id, degree, first): the sum of the degrees of all smaller ids."""
    return running_sums(degrees, ["id"], "degree", "first")


def row_offsets(graph: Graph) -> DataFrame:
    """Where each source's edges begin among edges in order of source."""
    return running_offsets(graph.out_degree())


def column_offsets(graph: Graph) -> DataFrame:
    """Where each destination's edges begin among edges in order of destination."""
    return running_offsets(graph.in_degree())


def rank_of(ranks: DataFrame, node: int) -> DataFrame:
    """The row of one node."""
    return ranks.where(F.col("id") == node)


def top_ranks(ranks: DataFrame, k: int = 10) -> DataFrame:
    """The k highest ranks, the smaller id first among equals."""
    return ranks.orderBy(F.desc("value"), "id").limit(k)
