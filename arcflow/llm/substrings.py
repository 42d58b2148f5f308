"""Substring deduplication: words in repeated windows go, but for the windows' first occurrences.

A window is `WINDOW` consecutive words of one document. A word goes if it is in a window
whose word sequence also starts earlier: in a document with a smaller id, or earlier in
the same. Windows are judged on the input.

1. Count-min prefilter. Each window chooses the smallest hash among its sub-windows of
   `INNER` words; what is counted is each chosen place once. Equal windows choose equal
   sub-windows, so a window occurs no more often than its chosen one is counted. Tasks
   sketch their texts' places in `DEPTH` rows of cells, as sparse arrays; the cell ranges
   merge the sketches and tell each part of the documents which of its cells count twice
   or more. A window is estimated repeated if all its cells do; none is lost.
2. Only those windows are grouped exactly, by 96 hash bits, to their first occurrences.
3. Each part removes the words of its estimated windows that aren't first occurrences.
   (A window that was overestimated is its own first occurrence and stays.)

A document whose whole text occurs in one with a smaller id loses all words that a window
covers; it takes no part in step 2.

Defined cases: a null text has no words; a document of under `WINDOW` words loses none;
a repeated row (same id and text) is judged like the row it repeats; of different texts
with one id, that with the smaller hash comes first; a null id comes before all others;
an empty table gives an empty table; columns other than the named and carried are ignored.

Scale: what every shuffle sends is linear in the input, in packs whose number grows with the
square of the parts (see `exchange`): the sketches of chosen places, the estimated windows,
and the packed texts twice. There may be 2^20 - 2 parts at most. Hot windows are one entry for each part;
copies of one text are salted where they meet their first (see `join_counted`).
The sketch grows with the text up to 2^`MOST_BITS` cells; from then on more windows are
estimated repeated than are, and are grouped exactly all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from arcflow.llm.exchange import NULL_ID, ROWS, Parts, Texts, bundles, by_group, chunks, destinations, numbered, open_bundle, pack, run_parts, steps, stream, total, unpack
from arcflow.llm.words import SLICE_BYTES, Words, buffers, hash_windows, hash_words, mix, slices, split, window_rows
from arcflow.plans.cut import cut
from arcflow.plans.spread import join_counted

WINDOW = 20
INNER = 14
DEPTH = 2
#: Cells of a row for each byte of text, at least.
CELLS_PER_BYTE = 0.5
#: Cells of a row, at most, as a power of two: a cell, its row and a part's number are packed in 64 bits.
MOST_BITS = 42
#: Chosen places that a task sketches at once, and estimated windows that a part groups at once.
FLUSH = 2_000_000
_SEEDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


class Places:
    """Windows of consecutive texts and the places they choose."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, window: int, inner: int) -> None:
        self.words: Words = split(data, rows)
        self.hashes = hash_words(self.words)
        self.starts, self.rows, _ = window_rows(self.words, window)
        g = hash_windows(self.hashes, inner)
        if len(self.starts):
            span = window - inner + 1
            at, width = np.arange(len(g)), 1
            while width < span:
                shift = min(width, span - width)
                left, right = at[:-shift], at[shift:]
                at = np.where(g[right] < g[left], right, left)
                width += shift
            chosen = at[self.starts]
            fresh = np.diff(chosen, prepend=-1) != 0
            self.places, self.choice = chosen[fresh], np.cumsum(fresh) - 1
            self.place_rows = self.rows[fresh]
            self.keys = g[self.places]
        else:
            self.places = self.choice = self.place_rows = np.empty(0, np.int64)
            self.keys = np.empty(0, np.uint64)


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each key in one row, with the row's number above, spread over the 64-bit space."""
    cell = mix(keys, _SEEDS[row]) >> np.uint64(64 - bits)
    return (np.uint64(row) << np.uint64(bits)) + cell


def _sketch(found: list[tuple[np.ndarray, np.ndarray]], parts: Parts, bits: int, depth: int) -> Iterator[tuple[int, int, bytes]]:
    """Questions about cells that are counted once here, and statements about those counted more often."""
    keys, owner = np.concatenate([k for k, _ in found]), np.concatenate([p for _, p in found])
    nobody = np.uint64((1 << 20) - 1)
    for row in range(depth):
        both = np.sort(cells(keys, row, bits) << np.uint64(20) | owner.astype(np.uint64))
        cell = both >> np.uint64(20)
        first = np.flatnonzero(np.diff(cell, prepend=np.uint64(1 << 63)) != 0)
        count = np.diff(np.append(first, len(cell)))
        asked = np.where(count > 1, cell[first] << np.uint64(20) | nobody, both[first])
        target = ((asked >> np.uint64(20)) * np.uint64(parts.count) // np.uint64(depth << bits)).astype(np.int64)
        for k, s in by_group(target, parts.count):
            yield int(parts.numbers[k]), 0, pack(steps(asked[s] >> np.uint64(20)), (asked[s] & nobody).astype(np.uint32))
        told = np.unique(both[np.repeat(count > 1, count)])
        owners = (told & nobody).astype(np.int64)
        order = np.argsort(owners, kind="stable")
        for k, s in by_group(owners[order], parts.count):
            yield int(parts.numbers[k]), 1, pack(steps(told[order][s] >> np.uint64(20)))


def _sketches(rows: DataFrame, parts: Parts, bits: int, window: int, inner: int, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple[int, int, bytes]]:
            found, size = [], 0
            for batch in batches:
                for piece in slices(batch, "text"):
                    places = Places(*buffers(piece.column("text")), window, inner)
                    found.append((places.keys, piece.column("part").to_numpy()[places.place_rows]))
                    size += len(places.keys)
                    if size > FLUSH:
                        yield from _sketch(found, parts, bits, depth)
                        found, size = [], 0
            if size:
                yield from _sketch(found, parts, bits, depth)

        yield from chunks(out())

    return rows.select("text", "part").mapInArrow(run, ROWS)


def _answers(sketches: DataFrame, parts: Parts) -> DataFrame:
    """To each part its cells that count twice or more in all."""
    def part(rows: Iterator[tuple[int, bytes]], dest: int) -> Iterator[tuple[int, int, bytes]]:
        cell, owner = [], []
        for kind, data in rows:
            if kind:
                yield dest, 0, data
            else:
                d, o = unpack(data)
                cell.append(total(d))
                owner.append(o)
        if not cell:
            return
        cell, owner = np.concatenate(cell), np.concatenate(owner)
        order = np.argsort(cell, kind="stable")
        cell, owner = cell[order], owner[order]
        first = np.flatnonzero(np.diff(cell, prepend=np.uint64(1 << 63)) != 0)
        sizes = np.diff(np.append(first, len(cell)))
        weight = np.add.reduceat(np.where(owner == (1 << 20) - 1, 2, 1), first)
        keep = np.repeat(weight > 1, sizes) & (owner != (1 << 20) - 1)
        cell, owner = cell[keep], owner[keep]
        order = np.argsort(owner, kind="stable")
        for k, s in by_group(owner[order].astype(np.int64), parts.count):
            yield int(parts.numbers[k]), 0, pack(steps(np.unique(cell[order][s])))

    return parts.deal(sketches).mapInArrow(run_parts(part), ROWS)


def _copies(rows: DataFrame, parts: Parts) -> DataFrame:
    """To each part its documents whose whole text occurs in one with a smaller id."""
    texts = rows.where("text <> ''").select("id", "hash", "part", F.md5("text").alias("digest"))
    first = cut(texts.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = join_counted(texts, first, ["digest"], "n", ["id"]).where("id > first").select("id", "hash", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                part = batch.column("part").to_numpy()
                order = np.argsort(part, kind="stable")
                ids, hashes = batch.column("id").to_numpy()[order], batch.column("hash").to_numpy()[order]
                for k, s in by_group(part[order], parts.count):
                    yield int(parts.numbers[k]), 1, pack(ids[s], hashes[s])

        yield from chunks(out())

    return later.mapInArrow(run, ROWS)


class _Known:
    """What a part has been told before its documents come."""

    def __init__(self, bits: int, window: int, inner: int, depth: int) -> None:
        self.bits, self.window, self.inner, self.depth = bits, window, inner, depth
        self.cells: list[np.ndarray] = []
        self.copies: set[tuple[int, int]] = set()
        self.first_docs: list[np.ndarray] = []
        self.first_starts: list[np.ndarray] = []
        self.ready = False

    def hear(self, kind: int, data: bytes) -> None:
        got = unpack(data)
        if kind == 0:
            self.cells.append(total(got[0]))
        elif kind == 1:
            self.copies.update(zip(got[0].tolist(), got[1].tolist(), strict=True))
        else:
            self.first_docs.append(got[0])
            self.first_starts.append(got[1])

    def close(self) -> None:
        if not self.ready:
            self.cells = np.unique(np.concatenate(self.cells)) if self.cells else np.empty(0, np.uint64)
            docs = np.concatenate(self.first_docs) if self.first_docs else np.empty(0, np.uint64)
            starts = np.concatenate(self.first_starts) if self.first_starts else np.empty(0, np.uint32)
            order = np.argsort(docs, kind="stable")
            self.first_docs, self.first_starts, self.ready = docs[order], starts[order], True

    def estimated(self, places: Places) -> np.ndarray:
        """Of each window, whether all its cells count twice or more."""
        high = np.ones(len(places.keys), bool)
        for row in range(self.depth):
            if not len(self.cells):
                high[:] = False
                break
            cell = cells(places.keys, row, self.bits)
            high &= self.cells[np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)] == cell
        return high[places.choice]

    def is_copy(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return np.fromiter((x in self.copies for x in zip(ids.tolist(), hashes.tolist(), strict=True)), bool, len(ids))

    def is_first(self, docs: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of windows by row of `docs` (see `_named`) and start in it, whether they are first occurrences."""
        names, where = np.unique(docs, return_inverse=True)
        low, high = np.searchsorted(self.first_docs, names), np.searchsorted(self.first_docs, names, "right")
        counts = high - low
        at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        mine = np.repeat(np.arange(len(names)), counts) << 32 | self.first_starts[at].astype(np.int64)
        return np.isin(where[rows] << 32 | starts, mine)


def _named(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """One number for each document by its id and the upper half of its text's hash."""
    return mix(mix(ids.view(np.uint64)) + ties)


def _ties(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _firsts(dealt: DataFrame, parts: Parts, known: tuple[int, int, int, int]) -> DataFrame:
    """To each part its first occurrences among windows estimated repeated."""

    def send(found: list[tuple[np.ndarray, ...]], owner: int) -> Iterator[tuple[int, int, bytes]]:
        h1, h2, ids, ties, starts = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((starts, ties, ids, h2, h1))
        h1, h2 = h1[order], h2[order]
        fresh = (np.diff(h1, prepend=~h1[:1]) != 0) | (np.diff(h2, prepend=h2[:1]) != 0)
        order = order[fresh]
        h1, h2, ids, ties, starts = h1[fresh], h2[fresh], ids[order], ties[order], starts[order]
        for k, s in by_group(parts.of_range(h1), parts.count):
            yield int(parts.numbers[k]), 0, pack(steps(h1[s]), h2[s], ids[s], ties[s], starts[s], np.array([owner], np.int64))

    def ask(rows: Iterator[tuple[int, bytes]], dest: int) -> Iterator[tuple[int, int, bytes]]:
        told, found, size = _Known(*known), [], 0
        for kind, data in rows:
            if kind < 3:
                told.hear(kind, data)
                continue
            told.close()
            for t in open_bundle(data, SLICE_BYTES):
                places = Places(t.raw, t.at, told.window, told.inner)
                if not len(places.starts):
                    continue
                pick = told.estimated(places) & ~told.is_copy(t.ids, t.hashes)[places.rows]
                if pick.any():
                    first, owner = places.starts[pick], places.rows[pick]
                    found.append((hash_windows(places.hashes, told.window)[first], (hash_windows(places.hashes, told.window, 1)[first] >> np.uint64(32)).astype(np.uint32), t.ids[owner], _ties(t.hashes)[owner], (first - places.words.bounds[owner]).astype(np.uint32)))
                    size += len(first)
                    if size > FLUSH:
                        yield from send(found, number[dest])
                        found, size = [], 0
        if found:
            yield from send(found, number[dest])

    def group(rows: Iterator[tuple[int, bytes]], dest: int) -> Iterator[tuple[int, int, bytes]]:
        got = [unpack(data) for _, data in rows]
        h1, h2, ids, ties, starts, owner = (np.concatenate(x) for x in zip(*((total(d), *more, np.repeat(part, len(d))) for d, *more, part in got), strict=True))
        order = np.lexsort((starts, ties, ids, h2, h1))
        h1, h2 = h1[order], h2[order]
        fresh = (np.diff(h1, prepend=~h1[:1]) != 0) | (np.diff(h2, prepend=h2[:1]) != 0)
        first = order[fresh]
        first = first[np.lexsort((starts[first], ids[first], owner[first]))]
        for k, s in by_group(owner[first], parts.count):
            yield int(parts.numbers[k]), 2, pack(_named(ids[first][s], ties[first][s]), starts[first][s])

    number = {int(n): k for k, n in enumerate(parts.numbers)}
    questions = dealt.mapInArrow(run_parts(ask), ROWS)
    return parts.deal(questions).mapInArrow(run_parts(group), ROWS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, inner: int = INNER, depth: int = DEPTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: its id, text_hash (xxhash64 of the text), n_words, n_removed, kept_text (kept words joined by one space).

    With columns to `carry`, these come first, and the text as it was in place of the id and the hash.
    """
    inner = min(inner, window)
    parts = Parts(docs.sparkSession)
    rows = numbered(docs, parts, id_col, text_col, F.col(text_col).isNull().alias("absent"), F.struct(*(carry or (id_col,))).alias("row"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(MOST_BITS, max(10, int(size * CELLS_PER_BYTE).bit_length()))
    if parts.count >= (1 << 20) - 1:
        raise ValueError("more parts than the packed questions can name")
    known = (bits, window, inner, depth)
    told = cut(_answers(_sketches(rows, parts, bits, window, inner, depth), parts).unionByName(_copies(rows, parts)))
    firsts = cut(_firsts(parts.deal(told.unionByName(bundles(rows, parts, 3))), parts, known))
    shape = StructType([*([rows.schema["row"], StructField("text", StringType())] if carry else [StructField("id", LongType()), StructField("text_hash", LongType())]), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, mine in destinations(stream(batches)):
            about = _Known(*known)
            for kind, data in mine:
                if kind < 3:
                    about.hear(kind, data)
                    continue
                about.close()
                for t in open_bundle(data, SLICE_BYTES):
                    places = Places(t.raw, t.at, window, inner)
                    words = places.words
                    cover = np.zeros(len(words.starts) + 1, np.int64)
                    if len(places.starts):
                        copy = about.is_copy(t.ids, t.hashes)[places.rows]
                        gone = copy | about.estimated(places)
                        ask = np.flatnonzero(gone & ~copy)
                        owner = places.rows[ask]
                        gone[ask] = ~about.is_first(_named(t.ids, _ties(t.hashes)), owner, places.starts[ask] - words.bounds[owner])
                        first = places.starts[gone]
                        np.add.at(cover, first, 1)
                        np.add.at(cover, first + window, -1)
                    removed = np.cumsum(cover[:-1]) > 0
                    running = np.concatenate(([0], np.cumsum(removed)))
                    own = [t.carried, _as_text(t)] if carry else [pa.array(t.ids, pa.int64(), mask=t.ids == NULL_ID), pa.array(t.hashes)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(words.counts), pa.array(np.diff(running[words.bounds])), _joined(words, ~removed)], names=shape.names)

    # A part's documents meet what it was told and its first occurrences.
    texts = bundles(rows, parts, 3, "absent", "row" if carry else None)
    done = parts.deal(told.unionByName(firsts).unionByName(texts)).mapInArrow(finish, shape)
    own = ["row.*", "text"] if carry else [F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "text_hash"]
    return done.select(*own, "n_words", "n_removed", "kept_text")


def _as_text(t: Texts) -> pa.Array:
    """The documents' texts, null where they were."""
    whole = pa.Array.from_buffers(pa.large_string(), len(t.ids), [None, pa.py_buffer(t.at.astype(np.int64)), pa.py_buffer(t.raw)])
    return pc.if_else(pa.array(t.flags.astype(bool)), pa.scalar(None, pa.string()), whole.cast(pa.string()))


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row joined by one space."""
    starts, sizes = words.starts[keep], (words.ends - words.starts)[keep] + 1
    ends = np.cumsum(sizes)
    data = np.append(words.data, np.uint8(0x20))[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
    data[ends - 1] = 0x20
    counts = np.concatenate(([0], np.cumsum(keep)))[words.bounds]
    bounds = np.concatenate(([0], ends))[counts]
    # Each row ends with a space of its own, which goes.
    full = np.diff(bounds) > 0
    drop = bounds[1:][full] - 1
    data = np.delete(data, drop)
    bounds = bounds - np.concatenate(([0], np.cumsum(full)))
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
