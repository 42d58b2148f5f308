"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Each text's UTF-8 bytes give triplets: three consecutive bytes, and three bytes with
one left out. Each triplet is hashed to one of 256 buckets. The digest has two bits for
a bucket, the quartile of its count among the text's bucket counts, and before them a
byte for the length (its logarithm in steps of 1.05) and the two quartile ratios.

Two digests differ by the sum of their buckets' quartile differences plus a weighted
length difference (the ratios are for readers of the digest and aren't compared), and the score is one less that difference over the largest that
digests of these buckets could have: 1 for equal digests, 0 for texts with no bucket in
common. Equal texts have equal fingerprints.

Defined cases: a null text is empty; a text under three bytes has no triplet, its digest
is all zero but for the length, and the likeness of two such digests rests on the length
alone. The next document follows in ascending id (ties in the order of the texts' hashes;
null ids first); after the last comes the first. One document is its own successor. An
empty table gives an empty table.

Scale: one shuffle of the documents into ranges of ids. The ranges' bounds are quantiles
of the ids; an id (or null) that is several quantiles has as many ranges of its texts'
hashes. Each range also gets a copy of the first document of the next, so that no task
needs more than one text ahead. A range holds about as many rows as any other, unless one
row is repeated that often.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arcflow.llm.words import buffers, slices

BUCKETS = 256
#: Weight of one step of length, in quartile steps of one bucket.
LENGTH_WEIGHT = 2
#: Offsets of the second and third byte of a triplet from the first.
TRIPLETS = ((1, 2), (2, 3), (1, 3))

_rng = np.random.default_rng(20_240_601)
_TABLES = [[_rng.permutation(256).astype(np.uint8) for _ in range(3)] for _ in TRIPLETS]


def counts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Bucket counts of each row of a buffer."""
    n = len(rows) - 1
    out = np.zeros((n, BUCKETS), np.int64)
    sizes = np.diff(rows)
    owner = np.repeat(np.arange(n) * BUCKETS, sizes)
    last = np.repeat(rows[1:], sizes)
    for (b, c), (ta, tb, tc) in zip(TRIPLETS, _TABLES, strict=True):
        m = len(data) - c
        if m <= 0:
            continue
        bucket = tc[tb[ta[data[:m]] ^ data[b : b + m]] ^ data[c:]]
        whole = np.arange(c, c + m) < last[:m]
        out += np.bincount((owner[:m] + bucket)[whole], minlength=n * BUCKETS).reshape(n, BUCKETS)
    return out


def digests(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Digest bytes of each row: length, quartile ratios, packed quartiles."""
    n = len(rows) - 1
    found = counts(data, rows)
    order = np.sort(found, axis=1)
    q1, q2, q3 = (order[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    codes = (found > q1).astype(np.uint8) + (found > q2) + (found > q3)
    out = np.zeros((n, 2 + BUCKETS // 4), np.uint8)
    out[:, 0] = np.minimum(255, np.round(np.log1p(np.diff(rows)) / np.log(1.05) / 2)).astype(np.uint8)
    top = np.maximum(q3[:, 0], 1)
    out[:, 1] = (q1[:, 0] * 15 // top) * 16 + q2[:, 0] * 15 // top
    for k in range(4):
        out[:, 2:] |= codes[:, k::4] << (2 * k)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded score in [0, 1] of digests, row by row."""
    far = np.abs(a[:, 0].astype(np.int64) - b[:, 0]) * LENGTH_WEIGHT
    most = np.maximum(a[:, 0], b[:, 0]).astype(np.int64) * LENGTH_WEIGHT
    for k in range(4):
        x, y = (a[:, 2:] >> (2 * k)) & 3, (b[:, 2:] >> (2 * k)) & 3
        far += np.where(x > y, x - y, y - x).sum(axis=1, dtype=np.int64)
        most += np.maximum(x, y).sum(axis=1, dtype=np.int64)
    return np.where(most > 0, 1 - far / np.maximum(most, 1), 1.0)


def _text_digests(texts: list[str]) -> np.ndarray:
    found = []
    for part in slices(pa.record_batch({"text": pa.array(texts, pa.large_string())}), "text"):
        found.append(digests(*buffers(part.column("text"))))
    return np.concatenate(found)


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next document's first, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _in_order(schema: pa.Schema):
    """For mapInArrow over rows sorted by (range, copy, key, tie): rows of (id, text, range, copy)."""

    def results(ids: list, texts: list[str], following: list[str], ahead: np.ndarray) -> pa.RecordBatch:
        edited = [edit(t, f) for t, f in zip(texts, following, strict=True)]
        own, changed = _text_digests(texts), _text_digests(edited)
        columns = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in changed], likeness(own, changed), likeness(own, ahead)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None
        for batch in batches:
            for part in slices(batch, "text"):
                rows = list(zip(part.column("id").to_pylist(), [t or "" for t in part.column("text").to_pylist()], part.column("range").to_pylist(), part.column("copy").to_pylist(), strict=True))
                rows = [waiting, *rows] if waiting else rows
                waiting = rows[-1]
                pairs = [(a[0], a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False) if not a[3] and a[2] == b[2]]
                if pairs:
                    ids, texts, following = map(list, zip(*pairs, strict=True))
                    yield results(ids, texts, following, _text_digests(following))

    return run


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id and the digest of its text as lowercase hex."""
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [x.tobytes().hex() for x in digests(*buffers(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(schema.field("id").type), pa.array(found)], schema=schema)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _range_of(cuts: list[float]) -> tuple[Column, Column]:
    """Number of a row's range in order of (key, tie), which reads column `at`, and `at`, the number of cuts at or below the key. Cuts ascend; a cut that is there several times is as many ranges of ties."""
    if not cuts:
        return F.lit(0), F.lit(0)
    single = sorted(set(cuts))
    times = [cuts.count(c) if cuts.count(c) > 1 else 0 for c in single]
    before = [sum(times[:k]) for k in range(len(times))]
    table, key = F.lit(single), F.col("key").cast("double")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(single).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.get(table, found + step - 1) <= key, found + step).otherwise(found))
    own = F.get(F.lit(times), F.col("at") - 1)
    tie = F.least(F.floor((F.col("tie").cast("double") / float(1 << 64) + 0.5) * own).cast("int"), own - 1)
    within = F.when(own == 0, 0).when(F.get(table, F.col("at") - 1) == key, tie).otherwise(own)
    return F.when(F.col("at") == 0, 0).otherwise(F.col("at") + F.get(F.lit(before), F.col("at") - 1) + within), at


def fingerprint_and_follow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see `edit`.

    Ids are integers. Columns: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    result = f"id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * parts
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    place, at = _range_of(sorted(rows.select(F.col("key").cast("double")).approxQuantile("key", [k / ranges for k in range(1, ranges)], 0.25 / ranges)))
    rows = rows.withColumn("at", at).withColumn("range", place.cast("int"))
    firsts = {r["range"]: r["first"] for r in rows.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[r]: order[k - 1] for k, r in enumerate(order)}
    table = spark.createDataFrame([(int(key), int(tie), int(into)) for (key, tie), into in before.items()], "key long, tie long, into int") if before else None
    if table is None:
        return rows.select("id", "text", "range", F.lit(False).alias("copy")).mapInArrow(_in_order(schema), result).withColumnRenamed("id", id_col)
    marked = rows.join(F.broadcast(table), ["key", "tie"], "left")
    both = marked.select("id", "text", "key", "tie", F.explode(F.when(F.col("into").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("copy")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("copy")), F.struct(F.col("into").alias("range"), F.lit(True).alias("copy"))))).alias("to")).select("id", "text", "key", "tie", "to.range", "to.copy")
    dealt = both.repartition(parts, "range").sortWithinPartitions("range", "copy", "key", "tie")
    return dealt.select("id", "text", "range", "copy").mapInArrow(_in_order(schema), result).withColumnRenamed("id", id_col)
