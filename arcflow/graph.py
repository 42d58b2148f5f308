"""Directed multigraphs as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcflow.plans.blocks import Blocks, blocks_of
from arcflow.plans.cut import cut
from arcflow.plans.spread import join_counted


class Graph:
    """Edges (src, dst) as a bag, and nodes (id): those given, or all that edges name.

    Parallel edges and self-loops count as they are. Edges with a null end are left out.
    Nodes that no edge names may be given; edges must not name other nodes than the given.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None) -> None:
        self.edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna()
        self.given = nodes.select(F.col("id").cast("long").alias("id")).dropna().distinct() if nodes is not None else None

    @property
    def nodes(self) -> DataFrame:
        if self.given is not None:
            return self.given
        rows = self.kept_pairs if "kept_pairs" in self.__dict__ else self.edges
        return rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    def check_nodes(self) -> None:
        """Raise if an edge names a node that isn't there."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        if not ends.join(self.nodes, "id", "left_anti").isEmpty():
            raise ValueError("an edge names a node that is not among the nodes")

    def out_degree(self) -> DataFrame:
        """(id, degree) of every node; parallel edges count each."""
        return self._degree("src", "dst")

    def in_degree(self) -> DataFrame:
        return self._degree("dst", "src")

    def _degree(self, end: str, other: str) -> DataFrame:
        """One pass over the edges: an edge counts at its one end and names the node at the other."""
        count = lambda c, n: F.struct(F.col(c).alias("id"), F.lit(n).cast("long").alias("n"))
        if self.given is None:
            rows = self.edges.select(F.explode(F.array(count(end, 1), count(other, 0))).alias("x")).select("x.*")
        else:
            rows = self.edges.select(count(end, 1).alias("x")).select("x.*").unionByName(self.given.select("id", F.lit(0).cast("long").alias("n")))
        return rows.groupBy("id").agg(F.sum("n").alias("degree"))

    def adjacency(self) -> DataFrame:
        """(src, nbrs, deg): each node with out-edges and its sorted out-neighbours, repeated as edges are. A row has all of a node's neighbours;
        walks use rows of bounded size instead."""
        return self.edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"), F.count(F.lit(1)).cast("int").alias("deg"))

    def pairs(self) -> DataFrame:
        """(src, dst, n): distinct edges and how often they are there."""
        return self.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def kept_pairs(self) -> DataFrame:
        """`pairs`, kept on the executors, so that a computation reads the edges once."""
        return self.pairs().persist(StorageLevel.MEMORY_AND_DISK)

    def links(self) -> DataFrame:
        """(src, dst, weight, own): one row per distinct edge, weighing its share of the source's out-edges,
        and one per node to itself with weight 0 and `own` set, so that no later join or union is needed to keep every node."""
        pairs = self.kept_pairs
        total = cut(pairs.groupBy("src").agg(F.sum("n").alias("degree"), F.count(F.lit(1)).alias("links")))
        met = join_counted(pairs, total, ["src"], "links", ["dst"])
        weighed = met.select("src", "dst", (F.col("n") / F.col("degree")).alias("weight"), F.lit(False).alias("own"))
        return weighed.unionByName(self.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"), F.lit(True).alias("own")))

    @cached_property
    def blocks(self) -> Blocks:
        """The graph as packed blocks, kept on the executors."""
        return blocks_of(self)

    @cached_property
    def n_pairs(self) -> int:
        return self.kept_pairs.count()

    @cached_property
    def n_nodes(self) -> int:
        return self.nodes.count()

    def drop_pairs(self) -> None:
        if "kept_pairs" in self.__dict__:
            self.__dict__.pop("kept_pairs").unpersist()

    def release(self) -> None:
        """Drop what is kept."""
        if "blocks" in self.__dict__:
            self.__dict__.pop("blocks").release()
        self.drop_pairs()
