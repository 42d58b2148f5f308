"""Binary edge files: all sources, then all destinations, as 32-bit little-endian integers without a header.

Such a file is a data source named `coo`: register it with `register(spark)`, then
`spark.read.format("coo").load(path)`. Each task reads two byte ranges of a local or mounted
file, or of one in a store that pyarrow opens. `read_coo` also reads from stores that only
Spark's readers reach, as fixed records with their offsets, whose halves meet in a join on
their place; a record is the longest that divides the file, so where twice the number of
edges has no divisor of some size, records are short and reading is slow, but right.
`write_coo` writes one file from edges sorted by destination, each task at its own offsets.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arcflow.plans.cut import cut

CHUNK_EDGES = 4_000_000
#: Ends in one record of a file that only Spark reads, at most.
RECORD = 16_384


def _local(path: str) -> str | None:
    """The path in mounted folders, if it is there."""
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:") if path.startswith("file:") else None if "://" in path else path


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    own = _local(path)
    return (pyarrow.fs.LocalFileSystem(), os.path.abspath(own)) if own else pyarrow.fs.FileSystem.from_uri(path)


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def _edges_of(path: str, size: int, edges: int | None) -> int:
    if size % 8 or (edges is not None and size != 8 * edges):
        raise ValueError(f"{path} has {size} bytes; a file of E edges has 8 E")
    return size // 8


def _check_nodes(path: str, end: np.ndarray, nodes: int | None) -> None:
    if len(end) and (end.min() < 0 or (nodes is not None and end.max() >= nodes)):
        raise ValueError(f"{path} names a node outside 0..{nodes}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, edges: int | None, nodes: int | None, chunk: int) -> None:
        store, own = _store(path)
        self.path, self.nodes, self.chunk = path, nodes, chunk
        self.total = _edges_of(path, store.get_file_info(own).size or 0, edges)

    def partitions(self) -> list[InputPartition]:
        return [_Range(a, min(a + self.chunk, self.total)) for a in range(0, max(self.total, 1), self.chunk)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        n = partition.last - partition.first
        store, own = _store(self.path)
        with store.open_input_file(own) as f:
            ends = [np.frombuffer(f.read_at(4 * n, base + 4 * partition.first), "<i4").astype(np.int64) for base in (0, 4 * self.total)]
        for end in ends:
            _check_nodes(self.path, end, self.nodes)
        yield pa.RecordBatch.from_pydict({"src": ends[0], "dst": ends[1]})


class CooSource(DataSource):
    """Options: path; edges, nodes (checked if given); chunk (edges for a task)."""

    @classmethod
    def name(cls) -> str:
        return "coo"

    def schema(self) -> str:
        return "src long, dst long"

    def reader(self, schema) -> DataSourceReader:
        number = lambda k: int(self.options[k]) if k in self.options else None
        return _Reader(self.options["path"], number("edges"), number("nodes"), number("chunk") or CHUNK_EDGES)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CooSource)


def _pyarrow_opens(path: str) -> bool:
    try:
        _store(path)
    except (OSError, ValueError, NotImplementedError):  # the store's own reader is missing here
        return False
    return True


def read_coo(spark: SparkSession, path: str, edges: int | None = None, nodes: int | None = None) -> DataFrame:
    """(src, dst) of a file in any store; `edges` and `nodes` are checked if given."""
    if _pyarrow_opens(path):
        register(spark)
        options = {k: str(v) for k, v in (("edges", edges), ("nodes", nodes)) if v is not None}
        return spark.read.format("coo").options(**options).load(path)
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    total = _edges_of(path, place.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(place).getLen(), edges)
    if not total:
        return spark.createDataFrame([], "src long, dst long")
    width = next(g for g in range(min(2 * total, RECORD), 0, -1) if 2 * total % g == 0)
    hadoop = "org.apache.hadoop"
    found = context.newAPIHadoopFile(path, f"{hadoop}.mapreduce.lib.input.FixedLengthInputFormat", f"{hadoop}.io.LongWritable", f"{hadoop}.io.BytesWritable", conf={"fixedlengthinputformat.record.length": str(4 * width)})
    records = found.toDF("begin long, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end = np.frombuffer(b"".join(batch.column("data").to_pylist()), "<i4").astype(np.int64)
            _check_nodes(path, end, nodes)
            first = batch.column("begin").to_numpy() // 4
            yield pa.RecordBatch.from_pydict({"place": (first[:, None] + np.arange(width)).ravel(), "node": end})

    ends = records.mapInArrow(run, "place long, node long")
    sources = ends.where(F.col("place") < total).select("place", F.col("node").alias("src"))
    targets = ends.where(F.col("place") >= total).select((F.col("place") - total).alias("place"), F.col("node").alias("dst"))
    return sources.join(targets, "place").select("src", "dst")


def write_coo(edges: DataFrame, path: str) -> int:
    """Write one file, by destination then source; the number of edges written.

    Tasks write their ranges of a mounted file at once, and again if they are repeated. Other stores take
    a file from one writer only, so there the tasks' blocks of bytes pass through the driver one by one.
    """
    ordered = cut(edges.select("src", "dst").repartitionByRange("dst", "src").sortWithinPartitions("dst", "src")).withColumn("part", F.spark_partition_id())
    sizes = {r["part"]: r for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high")).collect()}
    for r in sizes.values():
        for end in (r["low"], r["high"]):
            if not 0 <= end < 1 << 31:
                raise ValueError(f"{end} is not a 32-bit node id")
    offsets, total = {}, 0
    for part in sorted(sizes):
        offsets[part] = total
        total += sizes[part]["n"]
    own = _local(path)
    if own is not None:
        with open(own, "wb") as out:
            out.truncate(8 * total)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, done = None, 0
            with open(own, "r+b") as out:
                for batch in batches:
                    if batch.num_rows:
                        at = offsets[batch.column("part")[0].as_py()] if at is None else at
                        for base, column in ((0, "src"), (4 * total, "dst")):
                            out.seek(base + 4 * (at + done))
                            out.write(batch.column(column).to_numpy().astype("<i4").tobytes())
                        done += batch.num_rows
            yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

        written = ordered.mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
        if written != total:
            raise OSError(f"{written} of {total} edges were written to {path}")
        return total

    def blocks(column: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"data": pa.array([batch.column(column).to_numpy().astype("<i4").tobytes()], pa.binary())})

        return ordered.select(column).mapInArrow(run, "data binary")

    context = edges.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place, True)
    for column in ("src", "dst"):
        for row in blocks(column).toLocalIterator():
            out.write(bytearray(row["data"]))
    out.close()
    return total
