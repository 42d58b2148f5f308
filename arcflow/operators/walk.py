"""Random walks with restart.

From each node a walk of `length` steps: with probability `damping` to a random
out-neighbour (parallel edges count each; a node without any stays), else back to the
source. Every step counts a visit where it ends. A node's value is its visits over
`length` and the number of replicas.

Walkers travel, the adjacency doesn't: it lies in packed blocks (`plans/blocks.py`), and the
walkers of a range, of all replicas, move together on its arrays for as many steps as they
stay in it. Those that leave go to their next range as packed arrays, all in one exchange a
round. A hub's neighbours lie in several ranges: its walkers go on from the one that holds
the edge they drew.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcflow.functions.rng import uniform_array
from arcflow.graph import Graph
from arcflow.operators.fixed import CUT_EVERY, DAMPING, placed
from arcflow.plans.blocks import Block, Layout, Letter, Mail
from arcflow.plans.bounds import choose
from arcflow.plans.cut import cut
from arcflow.plans.rounds import Rounds

LENGTH = 100
SEED = 42
#: Rounds in one job.
CHAIN = 10
#: Kinds of mail: walkers that arrive by a step, and those that go on at another place of a hub.
ARRIVING, PASSED_ON = 1, 2
#: Walkers of a range that move together: a step makes several arrays as long as they are.
TOGETHER = 500_000
#: A walker's replica and step in one number.
STEP_BITS = 32


class _Walk:
    """One range's part in a round."""

    def __init__(self, block: Block, layout: Layout, visits: np.ndarray, length: int, seed: int, damping: float) -> None:
        self.block, self.layout, self.visits, self.length, self.seed, self.damping = block, layout, visits, length, seed, damping
        self.range = int(np.flatnonzero(layout.labels == block.label)[0])
        self.order = (block.src.astype(np.int64) << 40) | block.at
        self.leaving: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def _split(self, node: int) -> tuple[np.ndarray, int]:
        """First edges of a hub's places, and the range of the first one."""
        home, last = (int(f(np.array([node]))[0]) for f in (self.layout.homes, self.layout.lasts))
        return np.concatenate([[0], self.layout.first[home + 1 : last + 1]]), home

    def count(self, nodes: np.ndarray) -> None:
        self.visits += np.bincount(self.block.places(nodes), minlength=len(self.visits))

    def move(self, source: np.ndarray, cur: np.ndarray, code: np.ndarray) -> None:
        """Steps of walkers that are here, some after the others, until each has left or ended."""
        for k in range(0, len(cur), TOGETHER):
            self._move(*(x[k : k + TOGETHER] for x in (source, cur, code)))

    def _move(self, source: np.ndarray, cur: np.ndarray, code: np.ndarray) -> None:
        block, layout = self.block, self.layout
        hubs = {int(n) for n in block.ids[[0, -1]] if layout.homes(np.array([n]))[0] != layout.lasts(np.array([n]))[0]} if len(block.ids) else set()
        while True:
            t = code & ((1 << STEP_BITS) - 1)
            live = t < self.length
            if not live.all():
                source, cur, code, t = source[live], cur[live], code[live], t[live]
            if not len(cur):
                return
            key = (self.seed, code >> STEP_BITS, source, t)
            follow = uniform_array(*key, 0) < self.damping
            place = block.places(cur)
            degree = block.degree[place]
            edge = np.floor(uniform_array(*key, 1) * degree).astype(np.int64)
            go = follow & (degree > 0)
            there = np.full(len(cur), self.range)
            for hub in hubs:
                firsts, home = self._split(hub)
                at = np.flatnonzero(go & (cur == hub))
                there[at] = home + np.searchsorted(firsts, edge[at], "right") - 1
            passed = there != self.range
            if passed.any():
                self.leaving.append((PASSED_ON, there[passed], source[passed], cur[passed], code[passed]))
                stay = ~passed
                source, cur, code, follow, place, edge, go = (x[stay] for x in (source, cur, code, follow, place, edge, go))
            cur = np.where(follow, cur, source)
            if go.any():
                link = np.searchsorted(self.order, (place[go].astype(np.int64) << 40) | edge[go], "right") - 1
                cur[go] = block.dst[block.tgt[link]]
            code = code + 1
            to = layout.homes(cur)
            here = to == self.range
            self.leaving.append((ARRIVING, to[~here], source[~here], cur[~here], code[~here]))
            source, cur, code = source[here], cur[here], code[here]
            self.count(cur)

    def send(self, mail: Mail) -> None:
        mail.state(a=self.visits)
        for kind in (ARRIVING, PASSED_ON):
            some = [x[1:] for x in self.leaving if x[0] == kind and len(x[1])]
            if not some:
                continue
            to, *walkers = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.argsort(to, kind="stable")
            ranges, first = np.unique(to[order], return_index=True)
            ends = np.append(first[1:], len(order))
            for r, a, b in zip(ranges.tolist(), first.tolist(), ends.tolist(), strict=True):
                part = order[a:b]
                mail.add(int(self.layout.labels[r]), kind, n=len(part), **{k: x[part] for k, x in zip("abc", walkers, strict=True)})


def visits(graph: Graph, length: int = LENGTH, replicas: int = 1, seed: int = SEED, damping: float = DAMPING) -> DataFrame:
    """(id, visits) of every node over all replicas."""
    spark = graph.edges.sparkSession
    blocks = graph.blocks.for_walks()
    shared = spark.sparkContext.broadcast(tuple(blocks.layout))

    def seeded(block: Block, mail: Mail) -> None:
        home = block.ids[block.home]
        walk = _Walk(block, Layout(*shared.value), np.zeros(len(block.ids), np.int64), length, seed, damping)
        for replica in range(replicas):
            walk.move(home, home, np.full(len(home), replica << STEP_BITS))
        walk.send(mail)

    def turn(block: Block, state: Letter, letters: list[Letter], mail: Mail) -> None:
        walk = _Walk(block, Layout(*shared.value), state.a("<i8").copy(), length, seed, damping)
        for letter in letters:
            if letter.kind == ARRIVING:
                walk.count(letter.b("<i8"))
        if letters:
            walk.move(*(np.concatenate([getattr(x, k)("<i8") for x in letters]) for k in "abc"))
        walk.send(mail)

    with Rounds(spark) as store:
        mail = blocks.begin(seeded)
        while True:
            for _ in range(CHAIN):
                mail = blocks.turn(mail, turn)
            mail, seen = store.keep(mail, walking=F.sum("n"))
            if not seen["walking"]:
                break
        out = cut(blocks.values(mail, lambda block, state, letters: state.a("<i8"), "long").withColumnRenamed("value", "visits"))
        blocks.release()
        return out


def rank_monte_carlo(graph: Graph, length: int = LENGTH, replicas: int = 1, seed: int = SEED, damping: float = DAMPING) -> DataFrame:
    """Ranks (id, value): mean visits per step and replica; they add up to the number of nodes."""
    return visits(graph, length, replicas, seed, damping).select("id", (F.col("visits") / F.lit(float(length * replicas))).alias("value"))


def _expecting(block: Block, mail: Mail) -> None:
    ones = np.ones(len(block.ids))
    mail.state(a=ones, b=np.zeros(len(ones)))
    block.send(ones, mail)


def rank_expected(graph: Graph, length: int = LENGTH, damping: float = DAMPING, strategy: str = "auto") -> DataFrame:
    """The expectation of `rank_monte_carlo`: the mean of rounds 1 to `length` from 1, nodes without out-edges passing to themselves."""
    plan = choose(strategy, graph)

    def summed(block: Block, state: Letter, letters: list[Letter]) -> tuple[np.ndarray, np.ndarray]:
        old = state.a("<f8")
        value = (1 - damping) + damping * (block.received(letters) + np.where(block.degree == 0, old, 0))
        return value, state.b("<f8") + value

    def turn(block: Block, state: Letter, letters: list[Letter], mail: Mail) -> None:
        value, total = summed(block, state, letters)
        mail.state(a=value, b=total)
        block.send(value, mail)

    with Rounds(graph.edges.sparkSession) as store:
        if plan == "blocks":
            blocks = graph.blocks
            mail = blocks.begin(_expecting)
            for k in range(1, length):
                mail = blocks.turn(mail, turn)
                if k % CUT_EVERY == 0:
                    mail, _ = store.keep(mail)
            return cut(blocks.values(mail, lambda block, state, letters: summed(block, state, letters)[1] / length))
        stuck = graph.out_degree().where("degree = 0").select("id")
        whole = Graph(graph.edges.unionByName(stuck.select(F.col("id").alias("src"), F.col("id").alias("dst"))), graph.nodes)
        links, state = placed(whole, plan), whole.nodes.select("id", F.lit(1.0).alias("value"), F.lit(0.0).alias("total"))
        new = F.lit(1 - damping) + F.lit(damping) * F.sum(F.col("value") * F.col("weight"))
        for k in range(1, length + 1):
            # What is summed so far goes along with the ranks.
            state = links.meet(state).groupBy("dst").agg(new.alias("value"), (F.max(F.when(F.col("own"), F.col("total"))) + new).alias("total")).withColumnRenamed("dst", "id")
            if k % links.chain == 0 and k < length:
                state, _ = store.keep(state)
        ranks = cut(state.select("id", (F.col("total") / length).alias("value")))
        links.release()
        whole.release()
        return ranks
