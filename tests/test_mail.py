"""What ranges send to each other, and how many ranges there are."""

import random

import numpy as np
import pytest

from arcflow.graph import Graph
from arcflow.operators import fixed, walk
from arcflow.plans import bounds
from arcflow.plans.blocks import Block, Letter, Mail, packed_ids, planes, unpacked_ids, unplaned


@pytest.mark.parametrize("ids", [[], [5], [0, 1, 300], [-7, 0, 1 << 40], [-(1 << 63), (1 << 63) - 1], list(range(0, 70_000, 7))])
def test_ids_come_back(ids):
    ids = np.array(ids, np.int64)
    assert unpacked_ids(packed_ids(ids), len(ids)).tolist() == ids.tolist()


def test_numbers_come_back_with_all_bits():
    x = np.concatenate([np.random.default_rng(3).random(101), [0.0, -0.0, 1e-300, np.inf]])
    assert unplaned(planes(x)).tobytes() == x.tobytes()


def test_a_sum_takes_nine_bytes():
    """Eight of the number and one of the gap, where ids are close."""
    n = 1000
    block = Block(3, src=np.arange(n), weight=np.ones(n), tgt=np.arange(n), dst=np.arange(n) * 3, own=np.empty(0), to=np.array([9]), bounds=np.array([0, n]), pick=np.arange(n))
    mail = Mail(3)
    block.send(np.arange(n) / 7, mail)
    (label, data, *_), = mail.rows
    assert label == 9 and len(data) < 9.2 * n
    ids, sums = Letter(data).sums()
    assert ids.tolist() == (np.arange(n) * 3).tolist() and sums.tolist() == (np.arange(n) / 7).tolist()


def test_no_more_ranges_than_cores(spark):
    """What is sent falls with the number of ranges, so many shuffle partitions don't make more of them."""
    rng = random.Random(5)
    g = Graph(spark.createDataFrame([(rng.randrange(20_000), rng.randrange(20_000)) for _ in range(200_000)], "src long, dst long"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert g.blocks.ranges == spark.sparkContext.defaultParallelism == 4
        assert g.blocks.rows.columns == ["label", "ranking"] and g.blocks.for_walks().rows.columns == ["label", "walking"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert "kept_pairs" not in g.__dict__
    g.release()


def test_joins_of_rows_are_for_small_graphs(spark, monkeypatch):
    """Beyond the bounds the same ranks come from packed blocks, or from joins that send nothing to the driver."""
    g = Graph(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long"))
    assert [bounds.choose(s, g) for s in bounds.STRATEGIES] == ["blocks", "blocks", "broadcast", "shuffle"]
    want = sorted(map(tuple, fixed.rank_sync(g, 3, strategy="shuffle").collect()))
    monkeypatch.setattr(bounds, "SENT_NODES", 3)
    assert bounds.choose("broadcast", g) == "shuffle"
    monkeypatch.setattr(bounds, "JOINED_LINKS", 3)
    assert [bounds.choose(s, g) for s in ("broadcast", "shuffle")] == ["blocks"] * 2
    monkeypatch.setattr(fixed, "placed", None)  # not used any more
    got = sorted(map(tuple, fixed.rank_sync(g, 3, strategy="shuffle").collect()))
    assert [i for i, _ in got] == [i for i, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-12)
    g.release()


def test_rounds_with_hubs_are_not_chained(spark, monkeypatch):
    """With hubs a plan of several rounds would double with each."""
    n = 60
    g = Graph(spark.createDataFrame([(0, k) for k in range(1, n)] + [(k, (k + 1) % n) for k in range(n)], "src long, dst long"))
    kept = []
    keep = fixed.Rounds.keep
    monkeypatch.setattr(fixed.Rounds, "keep", lambda self, rows, **m: kept.append(1) or keep(self, rows, **m))
    fixed.rank_sync(g, 4, strategy="shuffle")
    assert len(kept) == 3
    walk.rank_expected(g, 3, strategy="shuffle")
    assert len(kept) == 5
    g.release()
