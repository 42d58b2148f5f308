"""Questions and answers between parts of the documents and parts of a hash space.

Documents are dealt to numbered parts by id and text, so that rows of one id or without
any spread unless their texts are equal, too. What a part needs to know about many keys
(how often a window occurs, what an n-gram counts) it asks of the ranges of the key
space, as packed arrays, and each range answers the parts that asked. A key is sent once
for each part that has it, however often it occurs there, so hot keys weigh no more than
others; nothing is broadcast, and what is sent is linear in the input. It is sent as a pack from
each part to each range, so packs grow with the square of the parts.

Rows between stages are (dest int, kind int, data binary). `data` is a compressed pack
of arrays, integers as byte planes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcflow.llm.words import buffers, slices

#: Of a packed array: the kind of its integers (empty for bytes) and its length.
HEADER = struct.Struct("<4sQ")
ROWS = "dest int, kind int, data binary"
NULL_ID = -(1 << 63)
#: Of zstandard; on text, twice the time of level 1 for an eighth less space.
LEVEL = 3
#: Text in the documents of one bundle, at most, unless a single one is longer.
BUNDLE_BYTES = 32 << 20


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of integers or bytes, each after its kind and length; integers as byte planes, which compress well if small or sorted and differenced."""
    out = []
    for x in arrays:
        kind, data = (b"", x) if isinstance(x, bytes) else (x.dtype.str.encode(), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
        out += [HEADER.pack(kind, len(data)), data]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray | bytes]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = HEADER.unpack_from(raw, at)
        at += HEADER.size
        kind = kind.rstrip(b"\0").decode()
        if not kind:
            out.append(raw[at : at + n])
        else:
            flat = np.frombuffer(raw, np.uint8, n, at)
            out.append(np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() if n else np.empty(0, kind))
        at += n
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """First differences of an ascending array, from 0."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def total(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)


class Parts:
    """Numbers of parts that Spark's hash deals one to each shuffle partition."""

    def __init__(self, spark: SparkSession) -> None:
        self.count = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found: dict[int, int] = {}
        size = 8 * self.count + 64
        while len(found) < self.count:
            rows = spark.range(size, numPartitions=1).select(F.col("id").cast("int").alias("n")).select("n", F.pmod(F.hash("n"), F.lit(self.count)).alias("p"))
            found = {r["p"]: r["n"] for r in rows.groupBy("p").agg(F.min("n").alias("n")).collect()}
            size *= 2
        self.numbers = np.array([found[p] for p in range(self.count)], np.int32)

    def deal(self, rows: DataFrame) -> DataFrame:
        """Rows of a destination in one task, in order of kind."""
        return rows.repartition(self.count, "dest").sortWithinPartitions("dest", "kind")

    def of_range(self, keys: np.ndarray) -> np.ndarray:
        """Index of the range of the 64-bit space in which each key is."""
        return ((keys >> np.uint64(32)) * np.uint64(self.count) >> np.uint64(32)).astype(np.int64)


def by_group(group: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(group, its slice) of an ascending array of groups."""
    edges = np.searchsorted(group, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, slice(int(edges[k]), int(edges[k + 1]))


def rows_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    dest, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"dest": pa.array(dest, pa.int32()), "kind": pa.array(kind, pa.int32()), "data": pa.array(data, pa.binary())})


def chunks(rows: Iterator[tuple[int, int, bytes]], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows with bounded data."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > limit or len(held) >= 5000:
            yield rows_batch(held)
            held, size = [], 0
    if held:
        yield rows_batch(held)


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(batch.column("dest").to_pylist(), batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True)


def run_parts(part: Callable[[Iterator[tuple[int, bytes]], int], Iterator[tuple[int, int, bytes]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over dealt rows: `part(rows of (kind, data), dest)` for each destination, to rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from chunks(row for dest, rows in destinations(stream(batches)) for row in part(rows, dest))

    return run


def destinations(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """Consecutive rows of each destination; a destination's rows must be used up before the next."""
    pending = next(rows, None)

    def own(dest: int) -> Iterator[tuple[int, bytes]]:
        nonlocal pending
        while pending is not None and pending[0] == dest:
            yield pending[1], pending[2]
            pending = next(rows, None)

    while pending is not None:
        dest = pending[0]
        mine = own(dest)
        yield dest, mine
        for _ in mine:
            pass


def numbered(docs: DataFrame, parts: Parts, id_col: str, text_col: str, *more) -> DataFrame:
    """(id, text, hash, part index, more columns) of documents; a null id is the least integer."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"), *more)
    return rows.withColumn("hash", F.xxhash64("text")).withColumn("part", F.pmod(F.xxhash64("id", "hash"), F.lit(parts.count)).cast("int"))


def bundles(rows: DataFrame, parts: Parts, kind: int, flag: str | None = None, carry: str | None = None) -> DataFrame:
    """Documents of each part as packs of (ids, hashes, flags, byte lengths, text, an Arrow stream of a column to carry)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                for piece in slices(batch, "text", BUNDLE_BYTES):
                    part = piece.column("part").to_numpy()
                    order = np.argsort(part, kind="stable")
                    piece = piece.take(pa.array(order))
                    data, at = buffers(piece.column("text"))
                    ids, hashes = piece.column("id").to_numpy(), piece.column("hash").to_numpy()
                    flags = piece.column(flag).to_numpy(zero_copy_only=False).astype(np.uint8) if flag else np.zeros(len(ids), np.uint8)
                    for k, s in by_group(part[order], parts.count):
                        more = [_stream_of(piece.select([carry]).slice(s.start, s.stop - s.start))] if carry else []
                        yield int(parts.numbers[k]), kind, pack(ids[s], hashes[s], flags[s], np.diff(at[s.start : s.stop + 1]), data[at[s.start] : at[s.stop]].tobytes(), *more)

        yield from chunks(out())

    return rows.select("id", "text", "hash", "part", *(c for c in (flag, carry) if c)).mapInArrow(run, ROWS)


def _stream_of(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Texts(NamedTuple):
    """Documents of a bundle: their bytes and n+1 offsets, and the column that was carried."""

    ids: np.ndarray
    hashes: np.ndarray
    flags: np.ndarray
    raw: np.ndarray
    at: np.ndarray
    carried: pa.Array | None


def open_bundle(data: bytes, limit: int) -> Iterator[Texts]:
    """A bundle's documents in slices of about `limit` bytes."""
    ids, hashes, flags, lengths, text, *more = unpack(data)
    raw, at = np.frombuffer(text, np.uint8), np.concatenate(([0], np.cumsum(lengths)))
    carried = pa.ipc.open_stream(more[0]).read_next_batch().column(0) if more else None
    begin = 0
    while begin < len(ids):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
        s = slice(begin, end)
        yield Texts(ids[s], hashes[s], flags[s], raw[at[begin] : at[end]], at[begin : end + 1] - at[begin], carried.slice(begin, end - begin) if carried is not None else None)
        begin = end
