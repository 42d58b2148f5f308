"""Graphs as packed blocks, one for each range of nodes, that stay in their partitions.

Nodes in order of id, each followed by its links in order of destination, are one sequence,
cut into ranges of equal weight: a link weighs 1, a node 1 and what it receives in a round.
So a range has its share of links however they are spread; a hub's links go on over several
ranges, and the hub has a place in each of them. Ranges are as large as a task can hold
beside the others of its executor, since what is sent falls with their number.

A block is a row of arrays. In a round, what was sent to a range meets its block in one
vectorised step, which sums what came in, updates the range's nodes and sends sums on: for
each range one array of sums by destination. A destination's in-links are summed where
their sources lie before anything moves, so a hot destination is one number from each range,
and a hub's places all get the same numbers. The blocks don't move: they are kept by label,
where labels are chosen so that their hashes deal one range to each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcflow.plans.cut import cut

#: Weight of a range: links, nodes and received sums that one task holds; about 30 bytes each, and 180 while a block is packed.
#: Each core of an executor has a range in its Python worker and some copies of the block in its JVM.
SHARE = 2_000_000

#: Weight of a range below which a graph has fewer ranges than there are cores or shuffle partitions, two at least: a round of a small graph is all overhead.
LEAST = 50_000

#: What ranges send to each other and, as kind 0, their state to themselves; `data` is packed, and the rest is there to be summed up.
MAIL = "label long, data binary, n long, links long, change double"
#: A block's arrays. ids: the range's nodes; home: whether the node's own row is here; degree: all its out-edges;
#: src, weight, at, tgt: of each link its source's place in ids, its share of the source's out-edges, the source's edges before it, its destination's place in dst;
#: dst, own: distinct destinations and what sources that no longer change send them, empty if there are none; to, bounds, pick: for each range sent to, its label and the places in dst of what it gets.
TYPES = {"ids": "<i8", "home": "?", "degree": "<i8", "src": "<i4", "weight": "<f8", "at": "<i8", "tgt": "<i4", "dst": "<i8", "own": "<f8", "to": "<i8", "bounds": "<i8", "pick": "<i4"}
#: What rounds of ranks and of walks read, a column each.
READ = {"ranking": ("ids", "home", "degree", "src", "weight", "tgt", "dst", "own", "to", "bounds", "pick"), "walking": ("ids", "home", "degree", "src", "at", "tgt", "dst")}


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, their bytes' numbers first."""
    data = [np.ascontiguousarray(x).tobytes() for x in arrays]
    return b"".join([np.array([len(x) for x in data], "<i8").tobytes(), *data])


def unpacked(data: pa.Buffer | bytes, kinds: list[str], skip: int = 0) -> list[np.ndarray]:
    """The arrays of `packed`, read in place, of these types; `skip` bytes come before."""
    ends = np.frombuffer(data, "<i8", len(kinds), skip)
    at, out = skip + 8 * len(kinds), []
    for size, kind in zip(ends.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def packed_ids(ids: np.ndarray) -> np.ndarray:
    """Ascending ids as bytes: the first, then the gaps in as few bytes each as the greatest needs."""
    gaps = np.diff(ids).view("u8")
    width = next(w for w in (1, 2, 4, 8) if int(gaps.max(initial=0)) < 1 << 8 * w)
    return np.concatenate([ids[:1].astype("<i8").view("u1"), gaps.astype(f"<u{width}").view("u1")])


def unpacked_ids(data: np.ndarray, n: int) -> np.ndarray:
    """The n ids of `packed_ids`."""
    out = np.empty(n, np.int64)
    if n:
        out[0] = data[:8].view("<i8")[0]
        if n > 1:
            out[1:] = data[8:].view(f"<u{(len(data) - 8) // (n - 1)}")
    return np.cumsum(out)


def planes(values: np.ndarray) -> np.ndarray:
    """Bytes of numbers by place, the first of all numbers before the second of any: like places are alike, and what moves or is written is compressed."""
    return np.ascontiguousarray(values, "<f8").view("u1").reshape(-1, 8).T.ravel()


def unplaned(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(8, -1).T).view("<f8").ravel()


class Layout(NamedTuple):
    """Of each range in order: its first node, whether it begins with the node's own row, the node's edges before its first link, and its label."""

    lo: np.ndarray
    fresh: np.ndarray
    first: np.ndarray
    labels: np.ndarray

    def homes(self, ids: np.ndarray) -> np.ndarray:
        """Range with each node's own row."""
        at = np.searchsorted(self.lo, ids, "left")
        here = np.minimum(at, len(self.lo) - 1)
        return np.where((self.lo[here] == ids) & self.fresh[here] & (at == here), at, at - 1)

    def lasts(self, ids: np.ndarray) -> np.ndarray:
        """Last range in which each node has a place."""
        return np.searchsorted(self.lo, ids, "right") - 1


class Block:
    """A block's arrays."""

    @classmethod
    def read(cls, table: pa.Table | pa.RecordBatch, reading: str, row: int = 0) -> Block:
        """The arrays of one column, in place."""
        names = READ[reading]
        return cls(table.column("label")[row].as_py(), **dict(zip(names, unpacked(table.column(reading)[row].as_buffer(), [TYPES[k] for k in names]), strict=True)))

    def __init__(self, label: int, **arrays: np.ndarray) -> None:
        self.label = label
        self.__dict__.update(arrays)

    def column(self, reading: str) -> pa.Array:
        return pa.array([packed([np.asarray(getattr(self, k), TYPES[k]) for k in READ[reading]])], pa.binary())

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where in `ids` each node is, or -1."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def send(self, value: np.ndarray, mail: Mail) -> None:
        """To each range the sums of `value` by weight over the links to its nodes."""
        sums = np.bincount(self.tgt, value[self.src] * self.weight, len(self.dst))
        if len(self.own):
            sums = sums + self.own
        for k, to in enumerate(self.to.tolist()):
            pick = self.pick[self.bounds[k] : self.bounds[k + 1]]
            mail.add(to, 1, a=packed_ids(self.dst[pick]), b=planes(sums[pick]))

    def received(self, letters: list[Letter]) -> np.ndarray:
        """Sum of what came in for each node, in the senders' order, so that all places of a hub have the same bits."""
        total = np.zeros(len(self.ids))
        for letter in letters:
            if letter.kind == 1:
                ids, sums = letter.sums()
                at = self.places(ids)
                total[at[at >= 0]] += sums[at >= 0]
        return total


class Letter:
    """A row of mail: its sender, its kind, and up to four arrays."""

    def __init__(self, data: pa.Buffer) -> None:
        self.sender, self.kind = np.frombuffer(data, "<i8", 2).tolist()
        self._data = data

    def _array(self, k: int, kind: str) -> np.ndarray:
        sizes = np.frombuffer(self._data, "<i8", 4, 16).tolist()
        return np.frombuffer(self._data, kind, sizes[k] // np.dtype(kind).itemsize, 48 + sum(sizes[:k]))

    def a(self, kind: str) -> np.ndarray:
        return self._array(0, kind)

    def b(self, kind: str) -> np.ndarray:
        return self._array(1, kind)

    def c(self, kind: str) -> np.ndarray:
        return self._array(2, kind)

    def d(self, kind: str) -> np.ndarray:
        return self._array(3, kind)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Of a letter that `Block.send` wrote: destinations and what they get."""
        sums = unplaned(self.b("u1"))
        return unpacked_ids(self.a("u1"), len(sums)), sums


class Mail:
    """Rows that a range sends."""

    def __init__(self, sender: int) -> None:
        self.sender, self.rows = sender, []

    def add(self, label: int, kind: int, n: int = 0, links: int = 0, change: float = 0.0, **arrays: np.ndarray) -> None:
        head = np.array([self.sender, kind], "<i8").tobytes()
        self.rows.append((label, head + packed([arrays.get(k, np.empty(0)) for k in "abcd"]), n, links, change))

    def state(self, n: int = 0, links: int = 0, change: float = 0.0, **arrays: np.ndarray) -> None:
        """What the range knows itself in the next round."""
        self.add(self.sender, 0, n, links, change, **arrays)

    def table(self) -> pa.Table:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["label", "data", "n", "links", "change"])


#: What a range does in a round: its block, its state, what it got, and the mail to add to.
Turn = Callable[[Block, Letter, list[Letter], Mail], None]


class Blocks:
    """Blocks of a graph, kept on the executors by label."""

    def __init__(self, spark: SparkSession, pack: Callable[[str], DataFrame], layout: Layout, nodes: int, ranges: int, reading: str = "ranking") -> None:
        self.spark, self._pack, self.layout, self.nodes, self.ranges, self.reading = spark, pack, layout, nodes, ranges, reading

    @cached_property
    def rows(self) -> DataFrame:
        """(label, arrays that a round reads), packed when first asked for."""
        return _deal_by_label(self._pack(self.reading), self.ranges)

    @property
    def _read(self) -> DataFrame:
        return self.rows.select("label", self.reading)

    @property
    def _grouped(self):
        return self._read.groupBy("label")

    def _each(self, work: Callable[[Block], pa.Table], schema: str) -> DataFrame:
        reading = self.reading

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    yield from work(Block.read(batch, reading, row)).to_batches()

        return self._read.mapInArrow(run, schema)

    def begin(self, work: Callable[[Block, Mail], None]) -> DataFrame:
        """Mail of the first round."""

        def run(block: Block) -> pa.Table:
            mail = Mail(block.label)
            work(block, mail)
            return mail.table()

        return self._each(run, MAIL)

    def begin_from(self, values: DataFrame, work: Callable[[Block, np.ndarray, Mail], None]) -> DataFrame:
        """Mail of the first round, from (id, value) of all nodes, which go to all their places."""
        shared, reading = self.spark.sparkContext.broadcast(tuple(self.layout)), self.reading

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layout = Layout(*shared.value)
            for batch in batches:
                ids, value = batch.column("id").to_numpy(), batch.column("value").to_numpy()
                home = layout.homes(ids)
                copies = layout.lasts(ids) - home + 1
                at = np.repeat(np.arange(len(ids)), copies)
                yield pa.RecordBatch.from_pydict({"label": layout.labels[home[at] + np.arange(len(at)) - (np.cumsum(copies) - copies)[at]], "id": ids[at], "value": value[at]})

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            block = Block.read(left, reading)
            mail = Mail(block.label)
            value = np.empty(len(block.ids))
            value[block.places(right.column("id").to_numpy())] = right.column("value").to_numpy()
            work(block, value, mail)
            return mail.table()

        placed = values.select("id", "value").mapInArrow(place, "label long, id long, value double")
        return self._grouped.cogroup(placed.groupBy("label")).applyInArrow(run, MAIL)

    def meet(self, mail: DataFrame, work: Callable[[Block, Letter, list[Letter]], pa.Table], schema: str) -> DataFrame:
        """Each block with its state and what was sent to it, in the senders' order. Only the mail moves."""

        reading = self.reading

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            letters = sorted((Letter(x.as_buffer()) for x in right.column("data")), key=lambda x: (x.kind, x.sender))
            return work(Block.read(left, reading), letters[0], letters[1:])

        return self._grouped.cogroup(mail.select("label", "data").groupBy("label")).applyInArrow(run, schema)

    def turn(self, mail: DataFrame, work: Turn) -> DataFrame:
        """Mail of the next round."""

        def run(block: Block, state: Letter, letters: list[Letter]) -> pa.Table:
            out = Mail(block.label)
            work(block, state, letters, out)
            return out.table()

        return self.meet(mail, run, MAIL)

    def values(self, mail: DataFrame, work: Callable[[Block, Letter, list[Letter]], np.ndarray], kind: str = "double") -> DataFrame:
        """(id, value) of each node at its home, of what `work` makes of the state."""

        def run(block: Block, state: Letter, letters: list[Letter]) -> pa.Table:
            value = work(block, state, letters)
            return pa.table({"id": block.ids[block.home], "value": value[block.home]})

        return self.meet(mail, run, f"id long, value {kind}")

    def kept(self, rows: DataFrame) -> Blocks:
        """Blocks from written rows, dealt as these are."""
        found = Blocks(self.spark, lambda reading: rows, self.layout, self.nodes, self.ranges, self.reading)
        found.rows  # noqa: B018
        return found

    def for_walks(self) -> Blocks:
        """The same ranges, with the arrays that walks need instead."""
        return Blocks(self.spark, self._pack, self.layout, self.nodes, self.ranges, "walking")

    def release(self) -> None:
        if "rows" in self.__dict__:
            self.__dict__.pop("rows").unpersist()


def _deal_by_label(rows: DataFrame, n: int) -> DataFrame:
    return kept_in_place(rows.repartition(n, "label").sortWithinPartitions("label"))


def kept_in_place(rows: DataFrame) -> DataFrame:
    """The rows, kept on the executors: computed now, as only then later plans know how they are dealt and don't deal them again."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    return rows


def labels_of(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions the least number that hashes to it."""
    tries = 16 * n
    while True:
        found = spark.range(tries).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("label")).toArrow()
        if found.num_rows == n:
            return found.sort_by("part").column("label").to_numpy()
        tries *= 2


class _End(NamedTuple):
    """Of a partition of the sequence: its weight, its last node's out-edges (none if all its rows are links of an earlier node), and those of them that it holds."""

    weight: int
    degree: int | None
    edges: int


def _sequence(graph, parts: int) -> DataFrame:
    """(src, dst, n, weight, degree): each node with its out-degree, then its links."""
    pairs = graph.kept_pairs
    end = lambda c, out, got: F.struct(F.col(c).alias("id"), out.alias("degree"), F.lit(got).alias("got"))
    ends = pairs.select(F.explode(F.array(end("src", F.col("n"), 0), end("dst", F.lit(0).cast("long"), 1))).alias("x")).select("x.*")
    if graph.given is not None:
        ends = ends.unionByName(graph.given.select("id", F.lit(0).cast("long").alias("degree"), F.lit(0).alias("got")))
    nodes = ends.groupBy("id").agg(F.sum("degree").alias("degree"), F.sum("got").alias("got"))
    # A range sends a node one number however many links it has to it, so a node receives no more than there are ranges.
    nodes = nodes.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0).cast("long").alias("n"), (F.least("got", F.lit(parts)) + 1).cast("long").alias("weight"), "degree")
    links = pairs.select("src", "dst", "n", F.lit(1).cast("long").alias("weight"), F.lit(0).cast("long").alias("degree"))
    return cut(nodes.unionByName(links).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")).withColumn("part", F.spark_partition_id())


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Own rows, and src, n, weight, degree."""
    return (batch.column("dst").is_null().to_numpy(zero_copy_only=False), *(batch.column(c).to_numpy() for c in ("src", "n", "weight", "degree")))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, end = None, _End(0, None, 0)
    for batch in batches:
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
            own, _, n, weight, degree = _columns(batch)
            last = np.flatnonzero(own)[-1:]
            if len(last):
                end = _End(end.weight + int(weight.sum()), int(degree[last[0]]), int(n[last[0] :].sum()))
            else:
                end = _End(end.weight + int(weight.sum()), end.degree, end.edges + int(n.sum()))
    if part is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "weight": pa.array([end.weight], pa.int64()), "degree": pa.array([end.degree], pa.int64()), "edges": pa.array([end.edges], pa.int64())})


def blocks_of(graph, share: int = SHARE, least: int | None = None) -> Blocks:
    """Blocks of a graph in ranges of at most `share`; no more than there are cores (or `least`) while they hold that, and fewer if they would be very small."""
    spark = graph.edges.sparkSession
    parts = least or min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Links and sums received are no more than twice the links, so that makes about as many ranges as may send a node something.
    ordered = _sequence(graph, max(parts, -(-2 * graph.n_pairs // share)))
    graph.drop_pairs()  # the sequence has them; blocks are to have the memory
    # A row for each partition goes to the driver: where its rows begin in the sequence, and in the links of which node.
    begins, at, degree, edges = {}, 0, 0, 0
    for r in ordered.mapInArrow(_ends, "part int, weight long, degree long, edges long").toArrow().sort_by("part").to_pylist():
        begins[r["part"]] = (at, degree, edges)
        at += r["weight"]
        degree, edges = (degree, edges + r["edges"]) if r["degree"] is None else (r["degree"], r["edges"])
    n = max(least or max(2, min(parts, -(-at // LEAST))), -(-at // share))
    size, labels = max(1, -(-at // n)), labels_of(spark, n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, src, n, weight, degrees = _columns(batch)
            at, degree, edges = carried or begins[batch.column("part")[0].as_py()]
            place = at + np.cumsum(weight) - weight
            latest = np.maximum.accumulate(np.where(own, np.arange(len(own)), -1))
            before = np.cumsum(n) - n
            degree = np.where(latest >= 0, degrees[latest], degree)
            edge = np.where(latest >= 0, before - before[latest], edges + before)
            carried = (at + int(weight.sum()), int(degree[-1]), int(edge[-1] + n[-1]))
            yield pa.RecordBatch.from_pydict({"range": place // size, "label": labels[place // size], "src": src, "dst": batch.column("dst"), "n": n, "degree": degree, "at": edge})

    dealt = ordered.mapInArrow(deal, "range long, label long, src long, dst long, n long, degree long, at long")
    first = dealt.groupBy("range").agg(F.min(F.struct("src", F.col("dst").isNotNull().alias("link"), "at")).alias("x"), F.count_if(F.col("dst").isNull()).alias("nodes")).select("range", "nodes", "x.*").toArrow().sort_by("range")
    nodes = int(first.column("nodes").to_numpy().sum())
    layout = Layout(first.column("src").to_numpy(), ~first.column("link").to_numpy(), first.column("at").to_numpy(), labels[first.column("range").to_numpy()])
    shared = spark.sparkContext.broadcast(tuple(layout))

    def packing(reading: str) -> DataFrame:
        return dealt.drop("range").repartition(n, "label").groupBy("label").applyInArrow(lambda rows: pack(rows, Layout(*shared.value), reading), f"label long, {reading} binary")

    return Blocks(spark, packing, layout, nodes, n)


def pack(rows: pa.Table, layout: Layout, reading: str) -> pa.Table:
    """A range's block, of its nodes' own rows and their links."""
    own, block = rows.column("dst").is_null().to_numpy(), Block(rows.column("label")[0].as_py())
    block.ids, place = np.unique(rows.column("src").to_numpy(), return_inverse=True)
    block.home, block.degree = np.zeros(len(block.ids), bool), np.zeros(len(block.ids), np.int64)
    block.home[place[own]] = True
    block.degree[place] = rows.column("degree").to_numpy()
    links = rows.filter(pa.array(~own))
    block.src, block.at = place[~own], links.column("at").to_numpy()
    order = np.lexsort((block.at, block.src))
    block.src, block.at = block.src[order], block.at[order]
    block.weight = links.column("n").to_numpy()[order] / block.degree[block.src]
    block.dst, block.tgt = np.unique(links.column("dst").to_numpy()[order], return_inverse=True)
    block.own = np.empty(0)
    address(block, layout)
    return pa.table([pa.array([block.label], pa.int64()), block.column(reading)], names=["label", reading])


def address(block: Block, layout: Layout) -> None:
    """Which ranges get the sums of which destinations: a destination's home and all other places of a hub."""
    home = layout.homes(block.dst)
    copies = layout.lasts(block.dst) - home + 1
    pick = np.repeat(np.arange(len(block.dst)), copies)
    to = np.repeat(home, copies) + np.arange(len(pick)) - np.repeat(np.cumsum(copies) - copies, copies)
    order = np.argsort(to, kind="stable")
    ranges, first = np.unique(to[order], return_index=True)
    block.pick, block.to, block.bounds = pick[order], layout.labels[ranges] if len(ranges) else ranges, np.append(first, len(order))
