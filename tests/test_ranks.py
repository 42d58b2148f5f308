import random

import pytest

from arcflow.graph import Graph
from arcflow.operators import active, fixed, layout, walk

#: Edges, number of nodes, and expected values: 50 and 500 rounds, active sets (rounds), to the greatest change, walks' expectation.
GRAPHS = {
    "cycle": ([(0, 1), (1, 2), (2, 0)], 3, [0.999956] * 3, [1.0] * 3, [0.991953] * 3, 18, [0.991953] * 3, [1.0] * 3),
    "chain": ([(0, 1), (1, 2)], 3, [0.15, 0.2775, 0.385875], [0.15, 0.2775, 0.385875], [0.15, 0.2775, 0.385875], 4, [0.15, 0.2775, 0.385875], [0.15, 0.284725, 2.565275]),
    "star": ([(1, 0), (2, 0), (3, 0)], 4, [0.5325, 0.15, 0.15, 0.15], [0.5325, 0.15, 0.15, 0.15], [0.5325, 0.15, 0.15, 0.15], 3, [0.5325, 0.15, 0.15, 0.15], [3.55, 0.15, 0.15, 0.15]),
    "parallel": ([(0, 1), (0, 1), (0, 2), (1, 0), (2, 0)], 3, [1.459279, 0.977058, 0.563529], [1.459459, 0.977027, 0.563514], [1.458434, 0.976772, 0.562561], 37, [1.458544, 0.977187, 0.563593], [1.46157, 0.97562, 0.56281]),
    "loop": ([(0, 0), (0, 1), (1, 0)], 2, [1.298186, 0.701725], [1.298246, 0.701754], [1.28657, 0.69433], 18, [1.290494, 0.697878], [1.299135, 0.700865]),
    "tail": ([(3, 0), (0, 1), (1, 0), (2, 1)], 4, [1.849911, 1.849911, 0.15, 0.15], [1.85, 1.85, 0.15, 0.15], [1.841599, 1.841599, 0.15, 0.15], 22, [1.841599, 1.841599, 0.15, 0.15], [1.85, 1.85, 0.15, 0.15]),
}


def graph(spark, edges, nodes=None):
    table = spark.createDataFrame(edges, "src long, dst long")
    return Graph(table, spark.createDataFrame([(n,) for n in nodes], "id long") if nodes is not None else None)


def values(ranks):
    return [r["value"] for r in ranks.orderBy("id").collect()]


def all_graphs(spark):
    """All graphs as one, which share no node: rounds of each are those of its own, and the names and places of their nodes."""
    edges, names = [], []
    for edges_of, n, *_ in GRAPHS.values():
        edges += [(a + len(names), b + len(names)) for a, b in edges_of]
        names += [None] * n
    return graph(spark, edges)


def expected(column):
    return [v for row in GRAPHS.values() for v in row[column]]


def test_small_graphs(spark):
    g = all_graphs(spark)
    assert values(fixed.rank_sync(g)) == pytest.approx(expected(2), abs=1e-6)
    assert values(fixed.rank_sync(g, 100, repeats=2)) == pytest.approx(expected(3), abs=1e-4)
    settled = active.settle(g)
    assert values(settled.ranks) == pytest.approx(expected(4), abs=1e-6)
    assert settled.counts.count() == max(row[5] for row in GRAPHS.values()) and settled.counts.orderBy("round").collect()[-1]["active"] == 0
    assert values(walk.rank_expected(g)) == pytest.approx(expected(7), abs=1e-6)
    g.release()


@pytest.mark.parametrize("name", ["chain", "star", "loop"])
def test_to_the_greatest_change(spark, name):
    edges, *_, rounds, greatest, _ = GRAPHS[name]
    g = graph(spark, edges)
    assert values(fixed.rank_linf(g)) == pytest.approx(greatest, abs=1e-6)
    assert active.settle(g).counts.count() == rounds
    g.release()


#: Ten calls of active sets, each from the last one's values: expected values and rounds in all.
TEN = {
    "cycle": ([0.998136] * 3, 18 + 9),
    "chain": ([0.15, 0.2775, 0.385875], 4 + 9),
    "star": ([0.5325, 0.15, 0.15, 0.15], 3 + 9),
    "parallel": ([1.45918, 0.976869, 0.563434], 37 + 9),
    "loop": ([1.295545, 0.700406], 18 + 2 + 2 + 7),
    "tail": ([1.848054, 1.848054, 0.15, 0.15], 22 + 9),
}


def test_ten_calls_of_active_sets(spark):
    g = all_graphs(spark)
    assert values(active.rank_async(g, repeats=10)) == pytest.approx([v for name in GRAPHS for v in TEN[name][0]], abs=1e-6)
    g.release()


@pytest.mark.parametrize("name", ["chain"])
def test_rounds_of_ten_calls(spark, name):
    g = graph(spark, GRAPHS[name][0])
    assert active.settle(g, repeats=10).counts.count() == TEN[name][1]
    g.release()


def test_ten_calls_to_the_greatest_change(spark):
    """A further call makes one round at least, and only as many as it needs."""
    g = graph(spark, GRAPHS["cycle"][0])
    once, more = values(fixed.rank_linf(g))[0], values(fixed.rank_linf(g, repeats=3))[0]
    assert more == pytest.approx(0.15 + 0.85 * (0.15 + 0.85 * once))
    assert values(fixed.rank_linf(g, repeats=3, strategy="shuffle"))[0] == pytest.approx(more)
    g.release()


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_strategies_agree(spark, strategy):
    rng = random.Random(3)
    g = graph(spark, [(rng.randrange(12), rng.randrange(14)) for _ in range(40)], range(16))
    for compute in (lambda s: fixed.rank_sync(g, 4, strategy=s), lambda s: fixed.rank_linf(g, 0.05, strategy=s), lambda s: active.rank_async(g, 0.05, strategy=s), lambda s: walk.rank_expected(g, 3, strategy=s)):
        assert values(compute(strategy)) == pytest.approx(values(compute("blocks")), abs=1e-12)
    g.release()


def test_walks_visit_every_step_and_near_their_expectation(spark):
    edges = GRAPHS["chain"][0] + GRAPHS["loop"][0]
    g = graph(spark, edges)
    visits = [r["visits"] for r in walk.visits(g, length=50, replicas=40).orderBy("id").collect()]
    assert sum(visits) == 3 * 50 * 40
    expected = values(walk.rank_expected(g, length=50))
    assert [v / 2000 for v in visits] == pytest.approx(expected, abs=0.12)


def test_nodes_without_edges_and_empty_graphs(spark):
    g = graph(spark, [(0, 1)], range(4))
    assert values(fixed.rank_sync(g)) == pytest.approx([0.15, 0.2775, 0.15, 0.15])
    assert [r["degree"] for r in g.out_degree().orderBy("id").collect()] == [1, 0, 0, 0]
    empty = graph(spark, [])
    assert fixed.rank_sync(empty).count() == 0 and active.rank_async(empty).count() == 0 and walk.rank_monte_carlo(empty).count() == 0
    with pytest.raises(ValueError):
        graph(spark, [(0, 9)], range(4)).check_nodes()


def test_a_loop_that_does_not_settle_raises(spark):
    with pytest.raises(Exception, match="after 2 rounds"):
        active.rank_async(graph(spark, GRAPHS["cycle"][0]), max_rounds=2)


def test_offsets_lookup_and_report(spark):
    g = graph(spark, GRAPHS["parallel"][0])
    assert [(r["id"], r["degree"], r["first"]) for r in layout.row_offsets(g).orderBy("id").collect()] == [(0, 3, 0), (1, 1, 3), (2, 1, 4)]
    assert [r["first"] for r in layout.column_offsets(g).orderBy("id").collect()] == [0, 2, 4]
    ranks = fixed.rank_sync(g)
    assert [r["id"] for r in layout.top_ranks(ranks, 2).collect()] == [0, 1]
    assert layout.rank_of(ranks, 1).count() == 1
    assert [(r["src"], r["nbrs"], r["deg"]) for r in g.adjacency().orderBy("src").collect()] == [(0, [1, 1, 2], 3), (1, [0], 1), (2, [0], 1)]
