"""Numbers are the same bits in Spark, in NumPy and in SQL."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from arcflow.functions import rng

KEYS = [(0, 0, 0, 0), (3, 7, 99, 1), (1, 12345, 5, 0), (0, 1 << 40, 2, 1), (2**31, (1 << 62) + 17, 0, 0)]


def test_three_engines(spark):
    columns = [np.array(x, np.int64) for x in zip(*KEYS, strict=True)]
    want = rng.uniform_array(42, *columns).tolist()
    rows = spark.createDataFrame(KEYS, "r long, s long, t long, k long")
    got = [x["u"] for x in rows.select("r", "s", rng.uniform(42, *map(F.col, "rstk")).alias("u")).orderBy("r", "s").collect()]
    assert got == [u for _, u in sorted(zip(KEYS, want, strict=True), key=lambda x: x[0][:2])]
    for key, u in zip(KEYS, want, strict=True):
        assert duckdb.execute(f"select {rng.uniform_sql(42, *key)}").fetchone()[0] == u
    negative = spark.range(1).select(rng.uniform(-1, F.lit(-(1 << 63))).alias("u")).first()["u"]
    assert negative == rng.uniform_array(-1, np.array([-(1 << 63)])).tolist()[0]


def test_they_are_uniform_and_apart():
    source, step = np.meshgrid(np.arange(2000), np.arange(50))
    a, b = (rng.uniform_array(42, 0, source.ravel(), step.ravel(), slot) for slot in (0, 1))
    other = rng.uniform_array(43, 0, source.ravel(), step.ravel(), 0)
    for x in (a, b, other):
        assert 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.003 and len(np.unique(x)) > 99_990
        counts = np.histogram(x, 64, (0, 1))[0]
        assert ((counts - counts.mean()) ** 2).sum() / counts.mean() < 120
    for x, y in ((a, b), (a, other), (a[1:], a[:-1]), (a.reshape(50, 2000)[1:], a.reshape(50, 2000)[:-1])):
        assert abs(np.corrcoef(x.ravel(), y.ravel())[0, 1]) < 0.015
