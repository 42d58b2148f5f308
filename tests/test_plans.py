"""Physical plans: what lies where, what moves, and how many jobs and files a loop takes."""

import os
import random
import statistics
import tracemalloc
from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from arcflow.functions.rng import uniform_array
from arcflow.graph import Graph
from arcflow.operators import active, fixed, walk
from arcflow.plans import cut
from arcflow.plans.blocks import SHARE, Block, Blocks, Layout, blocks_of, pack
from arcflow.plans.rounds import Rounds
from arcflow.plans.spread import join_counted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def outside_caches(text):
    """The lines of a plan that aren't below what is kept in memory."""
    out, deep = [], None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if deep is None or depth <= deep:
            deep = depth if "InMemoryRelation" in line else None
            out.append(line)
    return "\n".join(out)


def star(spark, n=400):
    """Half of all links leave one hub, and half of all links reach it."""
    rng = random.Random(4)
    rows = [(0, k) for k in range(1, n)] + [(k, 0) for k in range(1, n)] + [(rng.randrange(1, n), rng.randrange(1, n)) for _ in range(n)]
    return Graph(spark.createDataFrame(rows, "src long, dst long"))


def test_hot_keys_are_split(spark):
    rows = spark.createDataFrame([(0 if k % 3 else k, k) for k in range(300)], "key long, x long")
    single = cut.cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least")))
    want = rows.join(single, "key")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = join_counted(rows, single, ["key"], "n", ["x"])
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        tasks = lambda df: df.where("key = 0").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks(got) == 3 and tasks(want) == 1
        even = cut.cut(spark.range(300).select(F.col("id").alias("key"), F.lit(1).alias("n")))
        assert "_salt" not in plan(join_counted(rows, even, ["key"], "n", ["x"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("strategy", ["shuffle", "broadcast"])
def test_no_round_moves_a_link(spark, strategy):
    """Links are read where they are kept; exchanges are of ranks and of partial sums."""
    g = star(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        links = fixed.placed(g, strategy)
        assert (links.hubs is not None) == (strategy == "shuffle")
        if links.hubs is not None:
            assert [r["id"] for r in links.hubs.collect()] == [0]
        text = plan(fixed.step(links, cut.cut(fixed.start(g)), 0.85))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for line in text.split("+- InMemoryRelation")[0].splitlines():
        if "Exchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for later in text.splitlines()[text.splitlines().index(line) + 1 :]:
                if len(later) - len(later.lstrip(" :+-")) <= depth:
                    break
                below.append(later)
            if any("InMemoryTableScan" in x for x in below):
                assert any("HashAggregate" in x for x in below), line
    links.release()
    blocks, other = (sorted(map(tuple, fixed.rank_sync(g, 12, strategy=s).collect())) for s in ("blocks", strategy))
    assert [i for i, _ in blocks] == [i for i, _ in other]
    assert [v for _, v in other] == pytest.approx([v for _, v in blocks], abs=1e-12)
    g.release()


def half_star(spark, n, out):
    """Half of the links have one end in common, the others are random."""
    rng = random.Random(n)
    hub = n // 2
    rows = [(hub, k) if out else (k, hub) for k in range(n) if k != hub] + [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
    return Graph(spark.createDataFrame(rows, "src long, dst long"))


def opened(blocks: Blocks) -> list[Block]:
    table = blocks.rows.toArrow()
    return [Block.read(table, "ranking", k) for k in range(table.num_rows)]


@pytest.mark.parametrize("out", [True, False])
def test_ranges_have_equal_shares(spark, out):
    """A hub's links are several ranges, in all of which it has a place, and one partition has one range."""
    g = half_star(spark, 2000, out)
    blocks = blocks_of(g, least=8)
    found = opened(blocks)
    work = sorted(len(b.src) + len(b.ids) for b in found)
    assert len(found) == 8 and work[-1] <= 2 * statistics.median(work)
    assert sum(len(b.src) for b in found) == g.n_pairs and sum(b.home.sum() for b in found) == 2000 == blocks.nodes
    places = [b for b in found if 1000 in b.ids]
    assert (len(places) > 1) == out and sum(b.home[b.ids == 1000].sum() for b in places) == 1
    assert max(r["n"] for r in blocks.rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) == 1
    # Each range is told of a destination once, in all of its places.
    for b in found:
        assert sorted(set(b.pick.tolist())) == list(range(len(b.dst)))
    g.release()


def test_sums_received_are_in_a_range_s_share(spark):
    """Also where there are more ranges than cores, each of which may send a node something."""
    rng = random.Random(4)
    g = Graph(spark.createDataFrame([(rng.randrange(2000), rng.randrange(2000)) for _ in range(40_000)], "src long, dst long"))
    found = opened(blocks_of(g, share=4000))
    received = Counter()
    for b in found:
        received.update(dict(zip(b.to.tolist(), np.diff(b.bounds).tolist(), strict=True)))
    assert max(len(b.ids) + len(b.src) + received[b.label] for b in found) <= 4100
    assert len(found) <= 2 * 80_000 / 4000
    g.release()


def test_a_range_packs_beside_others():
    """Four cores pack a range each in half of the 4 GB that a heap of 6 GB leaves an executor of 10 GB."""
    n, rng = 200_000, np.random.default_rng(2)
    src, dst = np.sort(rng.integers(0, n // 10, n)), rng.integers(0, n, n)
    node = np.concatenate([[True], src[1:] != src[:-1]])
    rows = pa.table({"label": np.zeros(n, np.int64), "src": src, "dst": pa.array(dst, mask=node), "n": np.where(node, 0, 1), "degree": np.full(n, 9), "at": np.arange(n)})
    layout = Layout(np.array([0]), np.array([True]), np.array([0]), np.array([0]))
    tracemalloc.start()
    block = pack(rows, layout, "ranking")
    peak = tracemalloc.get_traced_memory()[1] + rows.nbytes + block.nbytes
    tracemalloc.stop()
    assert 4 * peak / n * SHARE < 2e9


@pytest.mark.parametrize("out", [True, False])
def test_hubs_in_all_loops(spark, out):
    g = half_star(spark, 80, out)
    g.__dict__["blocks"] = blocks_of(g, share=60, least=3)
    assert 4 <= len(g.blocks.layout.lo) <= 10
    other = Graph(g.edges)
    same = lambda a, b: sorted(map(tuple, a.collect())) == [(i, pytest.approx(v, abs=1e-12)) for i, v in sorted(map(tuple, b.collect()))]
    assert same(fixed.rank_sync(g, 7), fixed.rank_sync(other, 7, strategy="shuffle"))
    assert same(active.rank_async(g, 0.03, repeats=2), active.rank_async(other, 0.03, repeats=2, strategy="broadcast"))
    assert same(walk.rank_expected(g, 4), walk.rank_expected(other, 4, strategy="shuffle"))
    assert sorted(map(tuple, walk.visits(g, 12, 2).collect())) == plain_visits(g, 12, 2)
    for x in (g, other):
        x.release()


def plain_visits(g, length, replicas, seed=walk.SEED):
    nbrs = {r["src"]: r["nbrs"] for r in g.adjacency().collect()}
    nodes = [r["id"] for r in g.nodes.collect()]
    out = dict.fromkeys(nodes, 0)
    for r in range(replicas):
        for source in nodes:
            cur = source
            for t in range(length):
                u, v = (float(uniform_array(seed, r, source, t, k)) for k in (0, 1))
                cur = source if u >= 0.85 else nbrs[cur][int(v * len(nbrs[cur]))] if cur in nbrs else cur
                out[cur] += 1
    return sorted(out.items())


def test_walkers_of_a_range_move_some_at_a_time(monkeypatch):
    """However many gather in one range; they visit what they visit together."""
    n = 40
    arrays = dict(ids=np.arange(n), home=np.ones(n, bool), degree=np.where(np.arange(n) == 7, 0, 1), src=np.delete(np.arange(n), 7), at=np.zeros(n - 1, np.int64), tgt=np.zeros(n - 1, np.int64), dst=np.array([7]))
    layout = Layout(np.array([0]), np.array([True]), np.array([0]), np.array([0]))

    def visited():
        found = walk._Walk(Block(0, **arrays), layout, np.zeros(n, np.int64), 30, walk.SEED, 0.85)
        found.move(np.arange(n), np.full(n, 7), np.zeros(n, np.int64))
        return found.visits.tolist()

    want, moved = visited(), []
    move = walk._Walk._move
    monkeypatch.setattr(walk, "TOGETHER", 9)
    monkeypatch.setattr(walk._Walk, "_move", lambda self, source, *x: moved.append(len(source)) or move(self, source, *x))
    assert visited() == want and sum(want) == 30 * n and moved == [9, 9, 9, 9, 4]


def test_no_round_moves_a_block(spark):
    """Only mail is exchanged: where blocks are read, their partitions are those of the round."""
    g = star(spark)
    blocks = g.blocks
    text = outside_caches(plan(blocks.turn(blocks.begin(fixed.opening(0.85)), fixed.updating(0.85))))
    assert text.count("InMemoryTableScan") == 2  # the blocks, and those that sent the first mail
    assert text.count("Exchange hashpartitioning") == 1
    g.release()


def test_links_read_fall_with_the_active_set(spark):
    """Half of the graph settles at once, a ring with a tail later; links are kept anew and the results are the same."""
    rng = random.Random(8)
    ring = [(k, (k + 1) % 40) for k in range(40)] + [(0, 20), (7, 3)]
    fan = [(1000 + rng.randrange(900), rng.choice([0, 2000 + rng.randrange(50)])) for _ in range(3000)]
    g = Graph(spark.createDataFrame(ring + fan, "src long, dst long"))
    settled = active.settle(g)
    counts = settled.counts.orderBy("round").collect()
    links = [r["links"] for r in counts]
    assert links[0] == g.n_pairs and links == sorted(links, reverse=True) and links[-1] <= 42
    kept = counts[0]["active"]
    for now, later in zip(counts[:-1], counts[1:], strict=True):
        if now["active"] * 2 <= kept and now["active"]:
            assert later["links"] <= now["links"]
            kept = now["active"]
    joined = active.settle(g, strategy="shuffle")
    assert [r["active"] for r in counts] == [r["active"] for r in joined.counts.orderBy("round").collect()]
    a, b = (sorted(map(tuple, x.ranks.collect())) for x in (settled, joined))
    assert [i for i, _ in a] == [i for i, _ in b] and [v for _, v in a] == pytest.approx([v for _, v in b], abs=1e-12)
    g.release()


def test_one_job_a_round(spark):
    """The job that writes a round also takes what decides whether another follows."""
    g = Graph(spark.createDataFrame([(k, (k * 7 + 1) % 50) for k in range(50)] + [(3, k) for k in range(50)], "src long, dst long"))
    context = spark.sparkContext
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which makes a job of each exchange

    def jobs(compute):
        g.blocks.rows.count()
        group = f"jobs-{random.random()}"
        context.setJobGroup(group, "")
        out = compute()
        found = len(context.statusTracker().getJobIdsForGroup(group))
        context._jsc.clearJobGroup()
        return found, out

    try:
        for strategy in ("blocks",):
            few, a = jobs(lambda: active.settle(g, 0.05, strategy=strategy).counts)  # noqa: B023
            many, b = jobs(lambda: active.settle(g, 0.02, strategy=strategy).counts)  # noqa: B023
            rounds = b.count() - a.count()
            kept_anew = len({r["links"] for r in b.collect()}) - len({r["links"] for r in a.collect()})
            assert rounds > 2 and many - few <= rounds + 3 * abs(kept_anew)
            few, _ = jobs(lambda: fixed.rank_linf(g, 1e-3, strategy=strategy))  # noqa: B023
            more, _ = jobs(lambda: fixed.rank_linf(g, 1e-3 * 0.85**4, strategy=strategy))  # noqa: B023
            assert more - few <= 5
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    g.release()


def test_two_rounds_on_disk(spark, monkeypatch):
    """What is kept replaces what was kept two times before, and nothing stays, also after a failure."""
    seen = []
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    there = lambda: [x for x in os.listdir(folder) if x.startswith("rounds-")]
    before = set(there())
    keep = Rounds.keep

    def watched(self, rows, **metrics):
        out = keep(self, rows, **metrics)
        seen.append(sorted(os.listdir(self.folder.removeprefix("file:"))))
        return out

    monkeypatch.setattr(Rounds, "keep", watched)
    g = Graph(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long"))
    assert fixed.rank_linf(g, 0.008).count() == 3
    assert len(seen) > 4 and max(map(len, seen)) == 2 and seen[-1] == sorted(map(str, (len(seen) - 2, len(seen) - 1)))
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        active.rank_async(g, max_rounds=3)
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        fixed.rank_linf(g, max_rounds=3, strategy="shuffle")
    assert set(there()) == before
    g.release()


def test_hot_sources_are_split(spark):
    """Two thirds of the links leave one node: joins of links with their source's degree and rank."""
    rng = random.Random(2)
    rows = [(0, k) for k in range(20_000)] + [(rng.randrange(1, 20_000), rng.randrange(20_000)) for _ in range(10_000)]
    g = Graph(spark.createDataFrame(rows, "src long, dst long"))
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for joined in (g.links().where("not own"), fixed.messages(g, fixed.start(g))):
            sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
            assert max(sizes) < 2 * sum(sizes) / 8
        links = fixed.placed(g, "broadcast").links
        sizes = [r["n"] for r in links.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) < 1.5 * sum(sizes) / 8
        links.unpersist()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    g.release()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut.ensure_folder(Session())


def test_driver_gives_memory_back(spark, monkeypatch):
    """Garbage is collected and freed native memory returned at once if asked, else some seconds apart; a JVM that can't return it is no error."""
    assert "Trim native heap" in cut.trim_memory(spark)
    trims = []
    monkeypatch.setattr(cut, "trim_memory", trims.append)
    bean = MagicMock()
    cut.collect_garbage(bean, now=True)
    cut.collect_garbage(bean)
    assert trims == [bean] and bean.sparkContext._jvm.System.gc.call_count == 1

    def refuse(_):
        raise Py4JError("no such command")

    monkeypatch.setattr(cut, "trim_memory", refuse)
    cut.collect_garbage(bean, now=True)
    assert bean.sparkContext._jvm.System.gc.call_count == 2
