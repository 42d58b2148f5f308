"""Edge lists: text files, dense ids for arbitrary node names, and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcflow.operators.active import positions


def read_edge_text(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from tab-separated text without a header; lines that begin with # are skipped."""
    return spark.read.csv(path, sep="\t", comment="#", schema="src long, dst long")


def write_edge_text(edges: DataFrame, path: str) -> None:
    """Write tab-separated text without a header."""
    edges.select("src", "dst").write.csv(path, sep="\t")


def read_edge_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def write_edge_parquet(edges: DataFrame, path: str) -> None:
    """Write edges so that those of one destination are together and in order."""
    by_destination(edges).write.mode("overwrite").parquet(path)


def by_destination(edges: DataFrame) -> DataFrame:
    """The same edges, hashed to partitions by destination and sorted in them."""
    return edges.repartition("dst").sortWithinPartitions("dst", "src")


def dense_ids(edges: DataFrame) -> DataFrame:
    """(raw_id, id): distinct ends in ascending order, numbered from 0 without a single-task sort."""
    raw = edges.select(F.explode(F.array("src", "dst")).alias("raw_id")).dropna().distinct()
    return positions(raw, "raw_id", "id")


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their dense ids."""
    left = ids.select(F.col("raw_id").alias("src"), F.col("id").alias("src_id"))
    right = ids.select(F.col("raw_id").alias("dst"), F.col("id").alias("dst_id"))
    return edges.join(left, "src").join(right, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
