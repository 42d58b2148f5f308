"""Synchronous ranks: every node takes a new value from its in-neighbours in each round.

new(n) = (1 - damping) + damping * sum over edges s -> n of value(s) / out-degree(s),
starting from `damping`. Nodes without out-edges pass nothing on; nodes without in-edges
have the base value.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcflow.graph import Graph
from arcflow.plans.blocks import Block, Letter, Mail, kept_in_place
from arcflow.plans.bounds import choose
from arcflow.plans.cut import cut
from arcflow.plans.rounds import Rounds
from arcflow.plans.spread import hot_limit, join_counted

DAMPING = 0.85
TOLERANCE = 0.0015
ROUNDS = 50
MAX_ROUNDS = 10_000
#: Rounds of a fixed number between cuts of the lineage: what a lost executor costs at most.
CUT_EVERY = 10


def start(graph: Graph, damping: float = DAMPING) -> DataFrame:
    """Initial ranks."""
    return graph.nodes.select("id", F.lit(damping).alias("value"))


def messages(graph: Graph, ranks: DataFrame, damping: float = DAMPING) -> DataFrame:
    """What each edge passes on: (src, dst, message), a row for each parallel edge."""
    degree = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    sources = degree.join(ranks, degree["src"] == ranks["id"]).select("src", "degree", (F.lit(damping) * F.col("value") / F.col("degree")).alias("message"))
    return join_counted(graph.edges, cut(sources), ["src"], "degree", ["dst"]).select("src", "dst", "message")


class Placed(NamedTuple):
    """Links as a loop's rounds want them, kept on the executors, so that no round moves a link.

    With broadcast ranks they lie evenly, whatever their ends. Otherwise they lie by source, where the rounds send the ranks;
    those of hubs, fewer than twice the number of partitions, lie by destination and get the hubs' ranks by broadcast.
    """

    links: DataFrame
    hub_links: DataFrame | None
    hubs: DataFrame | None
    broadcast: bool

    @property
    def chain(self) -> int:
        """Rounds in one job. With hubs a round reads the last one's rows twice, so that a chain's plan would double with each."""
        return CUT_EVERY if self.hubs is None else 1

    def meet(self, state: DataFrame) -> DataFrame:
        """Links with the columns of `state` (id, ...) at their source."""
        if self.broadcast:
            return self.links.join(F.broadcast(state), self.links["src"] == state["id"])
        met = self.links.join(state, self.links["src"] == state["id"])
        if self.hub_links is None:
            return met
        few = state.join(F.broadcast(self.hubs), "id").select(*state.columns)
        return met.unionByName(self.hub_links.join(F.broadcast(few), self.hub_links["src"] == few["id"]))

    def release(self) -> None:
        for kept in (self.links, self.hub_links):
            if kept is not None:
                kept.unpersist()


def placed(graph: Graph, plan: str) -> Placed:
    parts = int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = graph.links()
    if plan == "broadcast":
        return Placed(kept_in_place(links.repartition(parts, "src", "dst")), None, None, True)
    hubs = cut(graph.kept_pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_limit(graph.edges, graph.n_pairs)).select(F.col("src").alias("id")))
    if hubs.isEmpty():
        return Placed(kept_in_place(links.repartition(parts, "src")), None, None, False)
    own = F.broadcast(hubs.withColumnRenamed("id", "src"))
    return Placed(kept_in_place(links.join(own, "src", "left_anti").repartition(parts, "src")), kept_in_place(links.join(own, "src").repartition(parts, "dst")), hubs, False)


def step(links: Placed, ranks: DataFrame, damping: float) -> DataFrame:
    """One round as a join and a partial and final sum: (id, value, old)."""
    total = F.lit(1 - damping) + F.lit(damping) * F.sum(F.col("value") * F.col("weight"))
    return links.meet(ranks).groupBy("dst").agg(total.alias("new"), F.max(F.when(F.col("own"), F.col("value"))).alias("old")).select(F.col("dst").alias("id"), F.col("new").alias("value"), "old")


def opening(value: float):
    """Every node at one value, and its first messages."""

    def run(block: Block, mail: Mail) -> None:
        start = np.full(len(block.ids), value)
        mail.state(a=start)
        block.send(start, mail)

    return run


def updating(damping: float):
    """A round: new values from the sums received, the greatest change, and the next messages."""

    def run(block: Block, state: Letter, letters: list[Letter], mail: Mail) -> None:
        value = (1 - damping) + damping * block.received(letters)
        mail.state(a=value, change=float(np.abs(value - state.a("<f8"))[block.home].max(initial=0)))
        block.send(value, mail)

    return run


def rank_sync(graph: Graph, iterations: int = ROUNDS, damping: float = DAMPING, repeats: int = 1, strategy: str = "auto") -> DataFrame:
    """Ranks (id, value) after `iterations` rounds; `repeats` calls each go on from the last one's values."""
    rounds = iterations * repeats
    plan = choose(strategy, graph)
    if not rounds:
        return cut(start(graph, damping))
    with Rounds(graph.edges.sparkSession) as store:
        if plan == "blocks":
            blocks = graph.blocks
            mail = blocks.begin(opening(damping))
            for k in range(1, rounds):
                mail = blocks.turn(mail, updating(damping))
                if k % CUT_EVERY == 0:
                    mail, _ = store.keep(mail)
            return cut(blocks.values(mail, lambda block, state, letters: (1 - damping) + damping * block.received(letters)))
        links, ranks = placed(graph, plan), start(graph, damping)
        for k in range(1, rounds):
            ranks = step(links, ranks, damping).select("id", "value")
            if k % links.chain == 0:
                ranks, _ = store.keep(ranks)
        ranks = cut(step(links, ranks, damping).select("id", "value"))
        links.release()
        return ranks


def rank_linf(graph: Graph, tolerance: float = TOLERANCE, damping: float = DAMPING, max_rounds: int = MAX_ROUNDS, strategy: str = "auto", repeats: int = 1) -> DataFrame:
    """Rounds as in `rank_sync` until no value changes by more than `tolerance`; `repeats` calls each go on from the last one's values.

    The job that writes a round also takes its greatest change."""
    plan = choose(strategy, graph)

    def settled(k: int, change: float | None) -> bool:
        if (change or 0) > tolerance and k + 1 == max_rounds:
            raise RuntimeError(f"values still change after {max_rounds} rounds")
        return (change or 0) <= tolerance

    if max_rounds < 1:
        raise ValueError("there must be a round")
    with Rounds(graph.edges.sparkSession) as store:
        if plan == "blocks":
            blocks = graph.blocks
            mail = blocks.begin(opening(damping))
            for _ in range(repeats):
                for k in range(max_rounds):
                    mail, seen = store.keep(blocks.turn(mail, updating(damping)), change=F.max("change"))
                    if settled(k, seen["change"]):
                        break
            return cut(blocks.values(mail, lambda block, state, letters: state.a("<f8")))
        links, ranks = placed(graph, plan), start(graph, damping)
        for _ in range(repeats):
            for k in range(max_rounds):
                both, seen = store.keep(step(links, ranks, damping), change=F.max(F.abs(F.col("value") - F.col("old"))))
                ranks = both.select("id", "value")
                if settled(k, seen["change"]):
                    break
        ranks = cut(ranks)
        links.release()
        return ranks
