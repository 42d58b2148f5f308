"""Near-duplicate documents by MinHash.

A document's set has its distinct shingles of `SHINGLE` lower-cased words; a document
with fewer words has its whole sequence as one; one without words has none and is linked
with nothing. Two documents are linked if 100 * intersection >= 75 * union.

1. One pass hashes each set with `BANDS * ROWS` universal hash functions and keeps the
   minima; documents with equal sets become one class.
2. Classes that agree in all rows of a band share a bucket. A pair at the threshold
   shares none with probability (1 - 0.75^4)^40 = 2.5e-7. Buckets' members are tied to
   their smallest, and components of these ties are the candidate groups. Where a group
   has more pairs than its buckets have together, its buckets are taken instead.
3. Groups are dealt in blocks of at most `BLOCK` documents. In a block, pairs whose
   signatures agree in less than `AGREE` of their rows are passed over (at the threshold
   that is 5.5 standard deviations low); the rest are confirmed on the full sets. A block
   returns no more links than it has documents. Groups of several blocks compare each
   block in itself and with the group's first document.
4. Documents outside their group's largest component after that meet all its blocks, if all
   that sends at most `SPREAD` rows for each candidate or they are at most `FEW` blocks; a
   group with more is dealt anew by rare shingles. With shingles in order of a sketched frequency, of two linked sets the
   smaller has a common shingle among its first n - ceil(6 n / 7) + 1, and the larger has it
   among its first n - ceil(3 n / 4) + 1: what a template of lower similarity shares isn't
   there, so its documents share no bucket. Members that a bucket has by the shorter
   prefix meet all its members.
5. Components of the confirmed links, by alternating large-star and small-star.

Defined cases: rows that share an id count as linked; rows with a null id are returned
with a null component and aren't kept. With `rows_apart`, rows without an id, and rows of
one id with different texts, are documents of their own, which come after all others in
the order of a hash; a component of such rows alone is null, and its first row is kept
(ids must be under 2^62 then). Repeated rows are returned once; an empty table gives an
empty table; columns other than the named are ignored.

Scale: the shuffles are of signatures, of bucket keys (twice), and of texts. No task sees
a whole bucket or group; buckets are counted with partial sums, and the rows of hot keys
are salted where they meet their counts (see `join_counted`). The sketch has
`CELLS` counters whatever the data. Nothing else about documents goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcflow.llm.components import connected_components
from arcflow.llm.words import LOWER, Words, buffers, hash_windows, hash_words, mix, slices, split, window_rows
from arcflow.plans.cut import cut, few
from arcflow.plans.spread import join_counted

SHINGLE = 5
BANDS, ROWS = 40, 4
AGREE = 0.56
BLOCK = 128
BLOCK_BYTES = 8 << 20
#: Blocks of documents outside a group's largest component that may meet all its blocks: as many copies of each document, and twice that at most.
FEW = 4
#: Rows for each candidate that such meetings may send in all, whatever the groups.
SPREAD = 4
#: Counters of the sketch that orders shingles by frequency.
CELLS = 1 << 16
#: Ids with several texts that may be broadcast, of 9 bytes each.
FEW_IDS = 1_000_000
#: Rows with a text or signature for each task, and rows of bucket keys, at least.
TEXT_ROWS, KEY_ROWS = 1_000, 50_000
#: Least place of documents without an id of their own.
NAMELESS = 1 << 62

_rng = np.random.default_rng(20_240_602)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    hashes = hash_words(words)
    positions, _, counts = window_rows(words, size)
    whole = hash_windows(hashes, size)[positions]
    ends = np.cumsum(counts)
    out = []
    for k, n in enumerate(words.counts.tolist()):
        if n >= size:
            out.append(np.unique(whole[ends[k] - counts[k] : ends[k]]))
        elif n:
            own = hashes[words.bounds[k] : words.bounds[k + 1]]
            out.append(hash_windows(own, n) ^ np.uint64(n))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(found: list[np.ndarray]) -> np.ndarray:
    """Sets by hash functions; a set must not be empty."""
    out = np.empty((len(found), BANDS * ROWS), np.uint64)
    for k, s in enumerate(found):
        s = s[:, None]
        low = (s[:256] * _A + _B).min(axis=0)
        for i in range(256, len(s), 256):
            np.minimum(low, (s[i : i + 256] * _A + _B).min(axis=0), out=low)
        out[k] = low
    return out


def _columns(texts: pa.Array) -> list[np.ndarray]:
    """Set size, two identity hashes, signature bytes and band keys of each text."""
    data, rows = buffers(texts)
    found = shingles(split(LOWER[data], rows))
    n = np.array([len(s) for s in found], np.int64)
    ids = np.zeros((2, len(found)), np.uint64)
    for k, s in enumerate(found):
        if len(s):
            ids[0, k], ids[1, k] = mix(s, 17).sum(dtype=np.uint64) + np.uint64(len(s)), mix(s, 71).sum(dtype=np.uint64)
    low = np.zeros((len(found), BANDS * ROWS), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        low[some] = minima([found[k] for k in some])
    keys = np.zeros((len(found), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r::ROWS])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
    return [n, ids[0].view(np.int64), ids[1].view(np.int64), (mix(low) >> np.uint64(48)).astype(np.uint16), keys.view(np.int64)]


def signatures(rows: DataFrame) -> DataFrame:
    """(id, own, text_hash, n, s1, s2, signature, keys) of rows (id, own, text_hash, text); without keys where the set is empty."""
    keys_type = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, s1, s2, sig, keys = _columns(part.column("text"))
                counts = np.where(n > 0, BANDS, 0)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("own"), part.column("text_hash"), pa.array(n), pa.array(s1), pa.array(s2), pa.array([x.tobytes() for x in sig], pa.binary()), lists.cast(keys_type)], names=["id", "own", "text_hash", "n", "s1", "s2", "signature", "keys"])

    return rows.mapInArrow(run, "id long, own long, text_hash long, n long, s1 long, s2 long, signature binary, keys array<long>")


def _links(texts: list[str], sig: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Confirmed links of a block as ties to the smallest id of each component in it."""
    n = len(texts)
    near = np.zeros((n, n), bool)
    for k in range(n - 1):
        near[k, k + 1 :] = (sig[k + 1 :] == sig[k]).mean(axis=1) >= AGREE
    near |= ids[:, None] == ids
    np.fill_diagonal(near, False)
    rows = np.flatnonzero(near.any(axis=1) | near.any(axis=0))
    if not len(rows):
        return
    found: list[np.ndarray] = []
    for part in slices(pa.record_batch({"text": pa.array([texts[k] for k in rows], pa.large_string())}), "text"):
        data, at = buffers(part.column("text"))
        found += shingles(split(LOWER[data], at))
    sizes = np.array([len(s) for s in found])
    owner = np.repeat(np.arange(len(rows)), sizes)
    values, where, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    common = counts > 1
    place = np.cumsum(common) - 1
    keep = common[where]
    owner, column = owner[keep], place[where[keep]]
    shared = np.zeros((len(rows), len(rows)), np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(64, (1 << 21) // len(rows))
    for first in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, (first, first + width))
        x = np.zeros((len(rows), width), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        shared += (x @ x.T).astype(np.int64)
    linked = 100 * shared >= 75 * (sizes[:, None] + sizes - shared)
    linked &= (near | near.T)[np.ix_(rows, rows)]
    linked |= ids[rows][:, None] == ids[rows]
    left = np.ones(len(rows), bool)
    for k in range(len(rows)):
        if left[k]:
            left[k] = False
            group, edge = [k], [k]
            while edge:
                fresh = np.flatnonzero(linked[edge].any(axis=0) & left).tolist()
                left[fresh] = False
                group += fresh
                edge = fresh
            least = int(ids[rows[group]].min())
            yield from ((int(ids[rows[g]]), least) for g in group if ids[rows[g]] != least)


def _confirm(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed ties (a, b) within each block (g, i, j) of `dealt` (g, i, j, id)."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.join(texts, "id").repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j", "id").select("g", "i", "j", "id", "text", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def done() -> list[tuple[int, int]]:
            if len(group) < 2:
                return []
            ids = np.array([g[0] for g in group])
            return list(_links([g[1] for g in group], np.stack([np.frombuffer(g[2], np.uint16) for g in group]), ids))

        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("g", "i", "j", "id", "text", "signature")]
            for g, i, j, *row in zip(*columns, strict=True):
                if (g, i, j) != key:
                    out += done()
                    key, group = (g, i, j), []
                if not group or group[-1] != row:
                    group.append(row)
            if out:
                yield _edges(out)
        if out := done():
            yield _edges(out)

    return rows.mapInArrow(run, "a long, b long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_apart: bool = False) -> DataFrame:
    """One row per document: its id, text_hash (xxhash64), n_shingles, component_id (smallest id reachable), kept (it is its component's first)."""
    given = docs.select(F.col(id_col).cast("long").alias("own"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    if rows_apart:
        nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("own", "text"), 2)
        hashes = docs.select(F.col(id_col).cast("long").alias("own"), F.xxhash64(text_col).alias("h")).where("own is not null")
        several = cut(hashes.groupBy("own").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("own", F.lit(True).alias("several")))
        # Rows don't move for ids with several texts unless those are many.
        n = several.count()
        marked = given.join(F.broadcast(several) if n <= FEW_IDS else several, "own", "left") if n else given.withColumn("several", F.lit(False))
        rows = marked.select(F.when(F.col("own").isNull() | F.col("several"), nameless).otherwise(F.col("own")).alias("id"), "own", "text_hash", "text")
    else:
        rows = given.select(F.col("own").alias("id"), "own", "text_hash", "text")
    base = cut(signatures(rows))
    total = base.count()
    some = base.where("n > 0 and id is not null")
    # A class's text is that of its first row: an id may have other texts, too.
    first = F.min(F.struct("id", "text_hash")).alias("first")
    classes = some.groupBy("s1", "s2").agg(first, F.first("signature").alias("signature"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows")).select("s1", "s2", "first.*", "signature", "keys", "rows")
    classes = cut(few(classes, total, TEXT_ROWS))
    links = _candidate_links(classes, rows, total)
    # Rows that share an id are linked, and each class with its first.
    shared = some.groupBy("id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("id")
    members = some.select("id", "s1", "s2").join(shared, "id", "left_semi")
    own = members.join(classes.select("s1", "s2", F.col("id").alias("b")), ["s1", "s2"]).where("id <> b").select(F.col("id").alias("a"), "b")
    components = connected_components(links.union(own))
    of_class = classes.select("s1", "s2", "rows", F.col("id").alias("node")).join(components, "node", "left").select("s1", "s2", "rows", F.coalesce("component", "node").alias("component"))
    rest = base.where("n = 0 or id is null").select("id", "own", "text_hash", "n", F.col("id").alias("component"))
    found = join_counted(some.select("id", "own", "text_hash", "n", "s1", "s2"), cut(few(of_class.select("s1", "s2", "rows", "component"), total)), ["s1", "s2"], "rows", ["id", "text_hash"]).select("id", "own", "text_hash", "n", "component")
    out = found.union(rest).distinct()
    kept = F.coalesce(F.col("component") == F.col("id"), F.lit(False))
    named = F.when(F.col("component") < NAMELESS, F.col("component")) if rows_apart else F.col("component")
    return out.select(F.col("own").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), named.alias("component_id"), kept.alias("kept"))


def _buckets(keyed: DataFrame, rows: int, only: str = "true") -> DataFrame:
    """(key, id, core, first, n) of keys with several members, of which some satisfy the aggregate condition `only`; `keyed` has at most `rows`."""
    keys = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.expr(only).alias("wanted")).where("n > 1 and wanted").drop("wanted")
    keys = cut(few(keys, rows, KEY_ROWS))
    return cut(few(join_counted(keyed, keys, ["key"], "n", ["id"]).select("key", "id", "core", "first", "n"), rows, KEY_ROWS))


def _blocks(n: str, size: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")


def _groups(members: DataFrame, texts: DataFrame, total: int, rows: int) -> DataFrame:
    """(g, id, core, head, blocks): clusters of buckets or, where those have more pairs than their buckets together, each bucket.
    There are at most `total` documents and `rows` members."""
    ties = members.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    clusters = connected_components(ties).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    length = texts.groupBy("id").agg(F.max(F.octet_length("text")).alias("bytes"))
    sized = cut(few(clusters.join(length, "id"), total))
    work = members.groupBy("key").agg(F.min("first").alias("id"), F.min("n").alias("n")).join(clusters, "id").groupBy("cluster").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
    counts = sized.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).join(work, "cluster")
    blocks = _blocks("n", "bytes")
    plans = cut(few(counts.select("cluster", "n", blocks.alias("blocks"), ((blocks > 1) & (F.col("work") < F.col("n").cast("double") * F.col("n"))).alias("apart")), total))
    planned = join_counted(sized, plans, ["cluster"], "n", ["id"])
    if plans.where("apart").isEmpty():
        return cut(few(planned.select(F.col("cluster").alias("g"), "id", F.lit(True).alias("core"), F.col("cluster").alias("head"), "blocks"), total))
    whole = planned.where("not apart").select(F.col("cluster").alias("g"), "id", F.lit(True).alias("core"), F.col("cluster").alias("head"), "blocks")
    apart = cut(few(members.select("key", "id", "core").join(planned.where("apart").select("id", "bytes"), "id"), rows, KEY_ROWS))
    each = cut(few(apart.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"), F.min("id").alias("head")), rows, KEY_ROWS))
    bucket = join_counted(apart, each, ["key"], "n", ["id"]).select(F.col("key").alias("g"), "id", "core", "head", _blocks("n", "size").alias("blocks"))
    return cut(few(whole.union(bucket), total + rows, KEY_ROWS))


def _block() -> Column:
    return F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")


def _alone(groups: DataFrame) -> DataFrame:
    """(g, i, j, id): each block for itself, with the group's first document."""
    to = F.when(F.col("id") == F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block()))
    return groups.select("g", F.explode(to).alias("i"), F.lit(-1).alias("j"), "id")


def _crossed(groups: DataFrame, rows: int) -> DataFrame:
    """(g, i, j, id): lanes of core members, each with every block of the group; `groups` has at most `rows`."""
    counts = cut(few(groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("cores")), rows))
    rows = join_counted(groups, counts, ["g"], "n", ["id"]).withColumn("of", F.greatest(F.lit(1), F.ceil(F.col("cores") * F.col("blocks") / F.col("n"))).cast("int"))
    lane = F.pmod(F.xxhash64("id", F.lit(1)), F.col("of")).cast("int")
    pairs = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(k.alias("i"), _block().alias("j"))),
        F.when(F.col("core"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(lane.alias("i"), k.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>")),
    )
    return rows.select("g", "id", F.explode(F.array_distinct(pairs)).alias("p")).select("g", "p.i", "p.j", "id")


def _open(groups: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """(g, id, core, blocks, rest): members of groups of several blocks that have members outside their largest component (core), `rest` of them; `groups` has at most `rows`."""
    large = groups.where("blocks > 1")
    settled = connected_components(links.join(large.select(F.col("id").alias("a")).distinct(), "a", "left_semi"))
    state = cut(few(large.join(settled.withColumnRenamed("node", "id"), "id", "left").select("g", "id", "blocks", F.coalesce("component", "id").alias("component")), rows))
    counts = state.groupBy("g", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("g").agg(F.max(F.struct("n", F.col("component").alias("main"))).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    found = join_counted(state, cut(few(main.select("g", "n", "top.main", (F.col("n") - F.col("top.n")).alias("rest")), rows)), ["g"], "n", ["id"])
    return few(found.select("g", "id", (F.col("component") != F.col("main")).alias("core"), "blocks", "rest"), rows)


def _texts_sets(part: pa.RecordBatch) -> list[np.ndarray]:
    data, at = buffers(part.column("text"))
    return shingles(split(LOWER[data], at))


def _cell(found: np.ndarray) -> np.ndarray:
    return (mix(found, 5) % np.uint64(CELLS)).astype(np.int64)


def sketch_frequencies(texts: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for found in _texts_sets(part):
                    np.add.at(counts, _cell(found), 1)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_pydict({"cell": some, "n": counts[some]})

    got = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return counts


def rare_shingles(rows: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """(key, id, core, outside) of the rare shingles of rows (id, outside, text); core where the shorter prefix has them."""
    shared = rows.sparkSession.sparkContext.broadcast(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids, outside = part.column("id").to_numpy(), part.column("outside").to_numpy(zero_copy_only=False)
                keys, cores, sizes = [], [], []
                for found in _texts_sets(part):
                    n = len(found)
                    long, short = n - (3 * n + 3) // 4 + 1, n - (6 * n + 6) // 7 + 1
                    chosen = found[np.lexsort((found, counts[_cell(found)]))[:long]]
                    keys.append(chosen)
                    cores.append(np.arange(len(chosen)) < short)
                    sizes.append(len(chosen))
                if sum(sizes):
                    yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys).view(np.int64), "id": np.repeat(ids, sizes), "core": np.concatenate(cores), "outside": np.repeat(outside, sizes)})

    return rows.select("id", "outside", "text").mapInArrow(run, "key long, id long, core boolean, outside boolean")


def _candidate_links(classes: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """Confirmed links between classes (by their first ids), of which there are at most `total`."""
    members = _buckets(classes.select(F.explode("keys").alias("key"), "id", F.lit(True).alias("core")), BANDS * total)
    needed = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "text_hash", "signature")
    texts = rows.select("id", "text_hash", "text").join(needed, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"]).select("id", "text", "signature")
    texts = cut(few(texts, total, TEXT_ROWS))
    groups = _groups(members, texts, total, BANDS * total)
    links = cut(_confirm(_alone(groups), texts))
    if groups.where("blocks > 1").isEmpty():
        return links
    size = groups.count()
    left = cut(_open(groups, links, size))
    # Documents outside meet all blocks while that sends no more than some rows for each candidate; beyond, groups with many of them are dealt anew.
    copies = F.ceil(F.col("rest") / BLOCK) + F.when(F.col("core"), F.col("blocks")).otherwise(0)
    spare = left.agg(F.sum(copies)).first()[0] <= SPREAD * size
    meet = F.lit(True) if spare else F.col("rest") <= FEW * BLOCK
    sizes = left.agg(F.count_if(meet).alias("few"), F.count_if(~meet).alias("many")).first()
    if sizes["few"]:
        links = links.union(cut(_confirm(_crossed(left.where(meet), size), texts)))
    if sizes["many"]:
        outside = left.where(~meet).groupBy("id").agg(F.bool_or("core").alias("outside"))
        keyed = cut(rare_shingles(texts.join(outside, "id"), sketch_frequencies(texts)))
        n = keyed.count()
        anew = _groups(_buckets(keyed, n, "bool_or(core) and bool_or(outside)"), texts, total, n)
        links = links.union(cut(_confirm(_crossed(anew, total + n), texts)))
    return links
