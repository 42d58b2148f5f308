"""Active-set ranks: a node whose value changes by at most the tolerance is frozen for good.

Active nodes take the same sums as in synchronous ranks, from all nodes' last values;
they commit the value of the round in which they settle. The loop ends when none is active.

Work follows the active set. A node that freezes tells the ranges that send to it, and when
half of the nodes are frozen that were active when links were last kept, the links are kept
anew: those to frozen nodes go, those from frozen nodes are folded into one constant for
each destination, and frozen nodes are set aside with their last values.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcflow.graph import Graph
from arcflow.operators.fixed import DAMPING, MAX_ROUNDS, TOLERANCE, Placed, placed, start
from arcflow.plans.blocks import Block, Blocks, Letter, Mail
from arcflow.plans.bounds import choose
from arcflow.plans.cut import cut
from arcflow.plans.rounds import Rounds

#: Links are kept anew when this share of the nodes is still active that was when they were last kept.
KEEP_AGAIN = 0.5

class Settled(NamedTuple):
    """ranks (id, value); counts (round, active, links): nodes still active after each round of each call, rounds from 1 throughout, and the links that the round read."""

    ranks: DataFrame
    counts: DataFrame


def step(links: Placed, state: DataFrame, tolerance: float, damping: float) -> DataFrame:
    """One round of joins; the nodes' own rows bring their old state, so that it is read once."""
    folded = links.meet(state).groupBy("dst").agg(
        (F.lit(1 - damping) + F.lit(damping) * F.sum(F.col("value") * F.col("weight"))).alias("new"),
        F.max(F.when(F.col("own"), F.col("value"))).alias("old"),
        F.bool_or(F.col("own") & F.col("active")).alias("was"),
        F.count_if(~F.col("own")).alias("links"),
    )
    return folded.select(F.col("dst").alias("id"), F.when(F.col("was"), F.col("new")).otherwise(F.col("old")).alias("value"), (F.col("was") & (F.abs(F.col("new") - F.col("old")) > tolerance)).alias("active"), "links")


class _State:
    """A range's values and active flags, and the frozen nodes that it knows of; of a block kept anew only the nodes that were active then."""

    def __init__(self, block: Block, state: Letter, letters: list[Letter]) -> None:
        self.value, self.active = state.a("<f8"), state.b("?")
        told = [x.a("<i8") for x in letters if x.kind == 2]
        if len(self.active) == len(block.ids):
            told.append(state.c("<i8"))
        else:
            self.value, self.active = self.value[self.active], self.active[self.active]
        self.frozen = np.unique(np.concatenate(told)) if told else np.empty(0, np.int64)


def _opening(damping: float):
    def run(block: Block, mail: Mail) -> None:
        _open(block, np.full(len(block.ids), damping), mail)

    return run


def _open(block: Block, value: np.ndarray, mail: Mail) -> None:
    mail.state(n=int(block.home.sum()), a=value, b=np.ones(len(value), bool))
    block.send(value, mail)


def _turn(tolerance: float, damping: float):
    def run(block: Block, state: Letter, letters: list[Letter], mail: Mail) -> None:
        old = _State(block, state, letters)
        new = (1 - damping) + damping * block.received(letters)
        value = np.where(old.active, new, old.value)
        active = old.active & (np.abs(new - old.value) > tolerance)
        mail.state(n=int((active & block.home).sum()), links=len(block.src), a=value, b=active, c=old.frozen)
        block.send(value, mail)
        settled = old.active & ~active & block.home
        if settled.any():
            for letter in letters:
                if letter.kind == 1:
                    ids = letter.sums()[0]
                    at = block.places(ids)
                    ids = ids[(at >= 0) & settled[at]]
                    if len(ids):
                        mail.add(letter.sender, 2, a=ids)

    return run


def _last(block: Block, state: Letter, letters: list[Letter]) -> np.ndarray:
    return _State(block, state, letters).value


def _active(block: Block, state: Letter, letters: list[Letter]) -> np.ndarray:
    return _State(block, state, letters).active


def _less(block: Block, state: Letter, letters: list[Letter]) -> pa.Table:
    """The block without frozen nodes, and the values of those that have their home here."""
    now = _State(block, state, letters)
    gone = now.active == 0
    wanted = ~np.isin(block.dst, now.frozen)
    frozen = gone[block.src]
    own = np.bincount(block.tgt[frozen], (now.value[block.src] * block.weight)[frozen], len(block.dst)) + (block.own if len(block.own) else 0)
    keep = ~frozen & wanted[block.tgt]
    place, at = np.cumsum(~gone) - 1, np.cumsum(wanted) - 1
    sent = wanted[block.pick]
    to = np.repeat(np.arange(len(block.to)), np.diff(block.bounds))[sent]
    some, first = np.unique(to, return_index=True)
    out = Block(
        block.label, ids=block.ids[~gone], home=block.home[~gone], degree=block.degree[~gone], src=place[block.src[keep]], weight=block.weight[keep], tgt=at[block.tgt[keep]],
        dst=block.dst[wanted], own=own[wanted], to=block.to[some], bounds=np.append(first, len(to)), pick=at[block.pick[sent]],
    )
    aside = gone & block.home
    arrays = [pa.array([x.tobytes()], pa.binary()) for x in (block.ids[aside], now.value[aside])]
    return pa.table([pa.array([out.label], pa.int64()), out.column("ranking"), *arrays], names=["label", "ranking", "aside", "values"])


def _set_aside(kept: DataFrame) -> DataFrame:
    """(id, value) of the nodes set aside with kept blocks."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, value = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("aside", "<i8"), ("values", "<f8")))
                yield pa.RecordBatch.from_pydict({"id": ids, "value": value})

    return kept.select("aside", "values").mapInArrow(run, "id long, value double")


def _settle_blocks(store: Rounds, whole: Blocks, mail: DataFrame, tolerance: float, damping: float, max_rounds: int, nodes: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Ranks of one call, and active nodes and links read in each round."""
    blocks, kept, aside, seen = whole, nodes, [], []
    while True:
        if len(seen) == max_rounds:
            raise RuntimeError(f"nodes are still active after {max_rounds} rounds")
        mail, now = store.keep(blocks.turn(mail, _turn(tolerance, damping)), active=F.sum("n"), links=F.sum("links"))
        seen.append((now["active"] or 0, now["links"] or 0))
        active = seen[-1][0]
        if not active:
            break
        if active <= KEEP_AGAIN * kept:
            less = store.set_aside(blocks.meet(mail, _less, "label long, ranking binary, aside binary, values binary"))
            aside.append(_set_aside(less))
            if blocks is not whole:
                blocks.release()
            blocks, kept = whole.kept(less.drop("aside", "values")), active
    ranks = blocks.values(mail, _last)
    for more in aside:
        ranks = ranks.unionByName(more)
    ranks = cut(ranks)
    if blocks is not whole:
        blocks.release()
    return ranks, seen


def settle(graph: Graph, tolerance: float = TOLERANCE, damping: float = DAMPING, repeats: int = 1, max_rounds: int = MAX_ROUNDS, strategy: str = "auto") -> Settled:
    """Run `repeats` calls, each with all nodes active from the last one's values. The job that writes a round also counts its active nodes."""
    spark, plan = graph.edges.sparkSession, choose(strategy, graph)
    seen: list[tuple[int, int]] = []
    with Rounds(spark) as store:
        if plan == "blocks":
            whole, ranks = graph.blocks, None
            for _ in range(repeats):
                mail = whole.begin(_opening(damping)) if ranks is None else whole.begin_from(ranks, _open)
                ranks, rounds = _settle_blocks(store, whole, mail, tolerance, damping, max_rounds, whole.nodes)
                seen += rounds
        else:
            links, ranks = placed(graph, plan), start(graph, damping)
            for _ in range(repeats):
                state, rounds = ranks.select("id", "value", F.lit(True).alias("active")), 0
                while True:
                    if rounds == max_rounds:
                        raise RuntimeError(f"nodes are still active after {max_rounds} rounds")
                    state, now = store.keep(step(links, state, tolerance, damping), active=F.count_if("active"), links=F.sum("links"))
                    state, rounds = state.drop("links"), rounds + 1
                    seen.append((now["active"] or 0, now["links"] or 0))
                    if not seen[-1][0]:
                        break
                ranks = state.select("id", "value")
            ranks = cut(ranks)
            links.release()
    counts = [(k, active, links) for k, (active, links) in enumerate(seen, 1)]
    return Settled(ranks, spark.createDataFrame(counts, "round long, active long, links long"))


def rank_async(graph: Graph, tolerance: float = TOLERANCE, damping: float = DAMPING, repeats: int = 1, max_rounds: int = MAX_ROUNDS, strategy: str = "auto") -> DataFrame:
    """Ranks (id, value) when no node is active."""
    return settle(graph, tolerance, damping, repeats, max_rounds, strategy).ranks


def frontier_positions(graph: Graph, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(id, position) of nodes active after one round: dense positions in order of id, from 0.

    Positions are running sums within ranges of ids plus the ranges' offsets, so that no task sees all nodes.
    """
    blocks = graph.blocks
    mail = blocks.turn(blocks.begin(_opening(damping)), _turn(tolerance, damping))
    return positions(blocks.values(mail, _active, "boolean").where("value").select("id"))


def positions(rows: DataFrame, column: str = "id", name: str = "position") -> DataFrame:
    """Rank from 0 of distinct values of a column in its order."""
    placed_rows = cut(rows.repartitionByRange(column).sortWithinPartitions(column)).withColumn("part", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed_rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("offset"))
    return placed_rows.join(F.broadcast(offsets), "part").select(*rows.columns, (F.col("offset") + F.col("within")).alias(name))
