"""Rounds of a loop on disk: each is written by one job, and two are there at most."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from arcflow.plans.cut import collect_garbage, ensure_folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the driver and all executors share."""
    ensure_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Rounds:
    """Two buffers: what is kept replaces what was kept two times before. Leaving the context deletes both, also after a failure.

    A round that is lost with an executor is computed from the last one kept, which is still there.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, shared_folder(spark, "rounds"), 0

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.folder)

    def keep(self, rows: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """The rows as written, and aggregates of them, taken by the job that writes them."""
        path, schema = f"{self.folder}/{self.n}", rows.schema
        seen = Observation() if metrics else None
        if seen:
            rows = rows.observe(seen, *(c.alias(k) for k, c in metrics.items()))
        rows.write.parquet(path)
        delete(self.spark, f"{self.folder}/{self.n - 2}")
        collect_garbage(self.spark)
        self.n += 1
        return self.spark.read.schema(schema).parquet(path), seen.get if seen else {}

    def set_aside(self, rows: DataFrame) -> DataFrame:
        """The rows as written, which stay until the loop ends."""
        path, schema = f"{self.folder}/aside-{uuid.uuid4().hex}", rows.schema
        rows.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)
