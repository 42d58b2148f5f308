"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

Questions and answers are normalised (A-Z lower-cased, every other ASCII character
but letters and digits a separator, non-ASCII characters kept) and cut into windows
of `window` consecutive words; an item with fewer words, but at least one, is one
window. All windows go into one automaton, which reads each normalised text once.
Matches are mapped back to word numbers and to code point ranges of the original.

Defined cases: a null or wordless text has no hits; items that are null, wordless
or without an id are not searched for; repeated item rows count once; repeated
document rows each get their own result; either table may be empty; columns other
than those named are ignored, whatever they are called.

Scale: one map over the documents without a shuffle; columns to carry stay where they
are. The automaton is broadcast as its items' text, whose size is measured first; if it
exceeds `shard_bytes`, items are dealt over several automata, each applied to all distinct
texts in a pass of its own, and hits are merged by digest. So each megabyte of items is a
pass; benchmarks are small against the documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcflow.llm.words import NORMAL_TABLE, buffers, slices

WINDOW = 10
#: Text of items in one automaton; its memory is about 250 times this.
SHARD_BYTES = 1_000_000

RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<begin:long,end:long>>"


def windows(words: list[bytes], size: int) -> list[tuple[int, str]]:
    """(number of words, key) of each window of an item; keys are Latin-1 views of the UTF-8 bytes."""
    size = min(size, len(words))
    return [(size, (b" " + b" ".join(words[i : i + size]) + b" ").decode("latin-1")) for i in range(len(words) - size + 1)] if words else []


def build(items: list[tuple[str, str]], size: int) -> ahocorasick.Automaton:
    """Automaton whose values are (words in the window, ids of the items with it)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        for n, key in windows(text.encode().translate(NORMAL_TABLE).split(), size):
            found.setdefault(key, (n, set()))[1].add(item)
    automaton = ahocorasick.Automaton()
    for key, (n, ids) in found.items():
        automaton.add_word(key, (n, tuple(ids)))
    if found:
        automaton.make_automaton()
    return automaton


def _spans(raw: bytes, normal: bytes, hit: np.ndarray) -> list[dict]:
    """Code point ranges of the original text covered by runs of hit words."""
    inside = np.frombuffer(normal, np.uint8) != 0x20
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    run = np.diff(hit.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
    return [{"begin": int(b), "end": int(e)} for b, e in zip(points[starts[first]], points[ends[last]], strict=True)]


def scan(automaton: ahocorasick.Automaton, raw: bytes, normal: bytes) -> tuple[int, int, list[str], list[dict]]:
    """Words, hit words, items found and hit ranges of one text."""
    words = normal.split()
    n = len(words)
    if not n or not len(automaton):
        return n, 0, [], []
    line = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return n, 0, [], []
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    last = np.searchsorted(gaps, [end for end, _ in found])
    first = last - [size for _, (size, _) in found]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, last, -1)
    hit = np.cumsum(cover)[:n] > 0
    return n, int(hit.sum()), sorted({i for _, (_, ids) in found for i in ids}), _spans(raw, normal, hit)


_built: dict[object, ahocorasick.Automaton] = {}


SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(SPAN))])


def _finder(items, size: int) -> Callable[[Column], Column]:
    """A function of a text column to what is found in it; `items` is a broadcast list."""

    def run(texts: pa.Array) -> pa.Array:
        known = items.value
        token = (hash(tuple(known)), size)
        if token not in _built:
            _built.clear()
            _built[token] = build(known, size)
        automaton, out = _built[token], []
        for part in slices(pa.record_batch({"text": texts}), "text"):
            data, rows = buffers(part.column("text"))
            raw = data.tobytes()
            normal = raw.translate(NORMAL_TABLE)
            found = [scan(automaton, raw[a:b], normal[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
            out.append(pa.StructArray.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*found, strict=True), FOUND, strict=True)], names=[f.name for f in FOUND]))
        return pa.concat_arrays(out) if out else pa.array([], FOUND)

    return F.arrow_udf(run, RESULT)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: its id (or the columns to carry), n_words, n_hit, item_ids (sorted as strings), spans (code points, end exclusive)."""
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(size / shard_bytes))

    def apply(rows: DataFrame, only: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in only.collect()])
        return rows.select("row", _finder(shared, window)(F.col("text")).alias("found")).select("row", "found.*")

    base = docs.select(F.struct(*(carry or (id_col,))).alias("row"), F.col(text_col).alias("text"))
    if shards == 1:
        return apply(base, wanted).select("row.*", "n_words", "n_hit", "item_ids", "spans")
    # Too many items for one automaton: a pass for each shard over the distinct texts, then the union of their hits.
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = base.groupBy(digest.alias("row")).agg(F.first("text").alias("text"))
    passes = [apply(texts, wanted.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k)) for k in range(shards)]
    union = passes[0]
    for more in passes[1:]:
        union = union.unionByName(more)
    merged = union.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    union_spans = F.expr("aggregate(spans, cast(array() as array<struct<begin:bigint,end:bigint>>), (a, s) -> case when size(a) > 0 and element_at(a, -1).end >= s.begin then concat(slice(a, 1, size(a) - 1), array(named_struct('begin', element_at(a, -1).begin, 'end', greatest(element_at(a, -1).end, s.end)))) else concat(a, array(s)) end)")
    spans = merged.withColumn("spans", union_spans).join(texts, "row")
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + size(regexp_extract_all(substring(text, cast(s.begin + 1 as int), cast(s.end - s.begin as int)), '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]+', 0)))")
    found = spans.select(F.col("row").alias("digest"), "n_words", hit.alias("n_hit"), "item_ids", "spans")
    return base.select("row", digest.alias("digest")).join(found, "digest").select("row.*", "n_words", "n_hit", "item_ids", "spans")
