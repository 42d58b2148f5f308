"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The model file is read here, without its library: pieces, scores, byte pieces and the
normaliser's flags. A text is encoded with an agenda of adjacent symbol pairs ordered
by score, then from left to right, as merge-type models prescribe. Where two adjacent
characters are neighbours in no piece, as a letter and the space mark after it, no merge
crosses them; a text is cut there and each unit's encoding is remembered. (A vocabulary
without such cuts is encoded text by text.)

Every encoding that a batch adds to the memory is compared with the sentencepiece
library's, and every decoded text with the library's decoding; a difference raises.

Defined cases: a null or empty text encodes to the end id alone and decodes to an empty
text; literal space marks decode as spaces, as in the library; an empty table gives an
empty table; other columns are ignored.

Scale: one map over the documents, without a shuffle. The vocabulary (about 0.5 MB) is
broadcast; the memory of units is bounded by `MEMORY` entries.
"""

from __future__ import annotations

import codecs
import struct
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arcflow.llm.words import Words, buffers, hash_words, slices

MARK = "▁"
MEMORY = 400_000
#: Longest unit that is merged in an array of many; longer ones use a heap.
ROW_WIDTH = 64
#: Fixed values of the model format: types of a piece.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _one_each(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("arcflow_each", _one_each)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            size, i = number(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = raw[i : i + size], i + size
        yield key >> 3, value


class PieceModel:
    """A merge-type model with dummy prefix and identity normalisation."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        pieces, trainer, normalizer = [], {}, {}
        for k, v in _fields(raw):
            if k == 1:
                x = dict(_fields(v))
                pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, bytes(4)))[0], x.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normalizer = dict(_fields(v))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or any(t == USER for _, _, t in pieces):
            raise ValueError("only merge-type models with identity normalisation, kept white space and no user-defined pieces are supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.order = {p: -s for p, s, t in pieces if t == NORMAL}
        self.bytes = {int(p[3:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN)
        self.end = trainer.get(42, 2)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        kinds = {NORMAL: lambda p: p.replace(MARK, " "), UNKNOWN: lambda p: trainer.get(44, " ⁇ ".encode()).decode()}
        self.texts = [kinds.get(t, lambda p: "")(p) for p, _, t in pieces]
        self.control = {i for i, (_, _, t) in enumerate(pieces) if t == CONTROL}
        # apart[a, b]: byte b never follows byte a in a piece, so that no merge crosses them; 0x20 stands for the mark.
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        for p in self.ids:
            x = p.replace(MARK, " ").encode()
            self.apart[list(x[:-1]), list(x[1:])] = False
        self.splits = self.prefix and bool(self.bytes) and self.apart[10].all(where=np.arange(256) < 128) and not any(" " in p or "\n" in p for p in self.ids)
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.texts)]
        self.raw_sizes = np.array([len(x) for x in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.raw_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._tables()
        self.forget()

    def _tables(self) -> None:
        """Symbols (pieces and the characters in them) and the pairs that join to a piece, sorted by key."""
        self.symbols = {p: k for k, p in enumerate(dict.fromkeys(chain(self.ids, *self.ids)))}
        self.symbol_of = np.full(0x110000, -2, np.int32)
        for p, k in self.symbols.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = k
        self.id_of = np.array([self.ids.get(p, -1) for p in self.symbols], np.int32)
        pairs = [(self.symbols[p[:k]] * len(self.symbols) + self.symbols[p[k:]], self.order[p], self.symbols[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols]
        keys, scores, joined = zip(*sorted(pairs), strict=True) if pairs else ((), (), ())
        self.pair_keys, self.pair_scores, self.pair_joined = np.array([*keys, np.iinfo(np.int64).max]), np.array([*scores, np.inf], np.float32), np.array([*joined, 0], np.int32)

    def forget(self) -> None:
        """Empty the memory of units: their hashes in order, and where their ids are in the pool."""
        self.known, self.starts, self.sizes, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    @cached_property
    def library(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.raw)

    def merge(self, text: str) -> list[int]:
        """Encoding of one unit: merge the pair with the best score, the leftmost of equals, until none is a piece."""
        symbols, order = list(text), self.order
        n = len(symbols)
        agenda = [(s, i, i + 1, 2) for i in range(n - 1) if (s := order.get(symbols[i] + symbols[i + 1])) is not None]
        if agenda:
            heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                _, i, j, size = heappop(agenda)
                if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                    continue
                joined = symbols[i] = symbols[i] + symbols[j]
                symbols[j] = ""
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (s := order.get(joined + symbols[k])) is not None:
                        heappush(agenda, (s, i, k, len(joined) + len(symbols[k])))
                k = before[i]
                if k >= 0 and (s := order.get(symbols[k] + joined)) is not None:
                    heappush(agenda, (s, k, i, len(joined) + len(symbols[k])))
        out: list[int] = []
        for x in symbols:
            if x:
                known = self.ids.get(x)
                if known is not None:
                    out.append(known)
                elif self.bytes:
                    out += [self.bytes[b] for b in x.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and joined symbol of pairs; infinite where they don't join."""
        key = left * np.int64(len(self.symbols)) + right
        at = np.searchsorted(self.pair_keys, key)
        fits = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(fits, self.pair_scores[at], np.float32(np.inf)), self.pair_joined[at]

    def merge_many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`merge` of many units: their ids one after another, and the number of each.

        Short units keep their agendas as the rows of an array, of which each round takes the best pair.
        """
        lengths = np.array([len(u) for u in units])
        points = self.symbol_of[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        first = np.cumsum(lengths) - lengths
        widths = np.maximum(4, 1 << np.ceil(np.log2(lengths)).astype(np.int64))
        odd = np.zeros(len(units), bool)
        np.logical_or.at(odd, np.repeat(np.arange(len(units)), lengths)[points < 0], True)
        odd |= widths > ROW_WIDTH
        sizes, done = np.zeros(len(units), np.int64), []
        for width in np.unique(widths[~odd]):
            rows = np.flatnonzero((widths == width) & ~odd)
            lens = lengths[rows]
            syms = np.full((len(rows), width), -1, np.int32)
            syms[np.arange(width) < lens[:, None]] = points[np.repeat(first[rows] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
            score, joined = self._lookup(syms[:, :-1], syms[:, 1:])
            live, now, places = np.arange(len(rows)), syms, np.arange(width - 1, dtype=np.int8)
            while len(live):
                best = score.argmin(axis=1)
                each = np.arange(len(live))
                keep = score[each, best] < np.inf
                if not keep.all():
                    syms[live[~keep]] = now[~keep]
                    live, best, now, score, joined = live[keep], best[keep], now[keep], score[keep], joined[keep]
                    each = np.arange(len(live))
                    if not len(live):
                        break
                lens[live] -= 1
                now[each, best] = joined[each, best]
                behind = places >= best.astype(np.int8)[:, None]
                now[:, 1:-1] = np.where(behind[:, :-1], now[:, 2:], now[:, 1:-1])
                now[:, -1] = -1
                score[:, :-1] = np.where(behind[:, :-1], score[:, 1:], score[:, :-1])
                joined[:, :-1] = np.where(behind[:, :-1], joined[:, 1:], joined[:, :-1])
                score[:, -1] = np.inf
                for at in (best - 1, best):
                    fits = (at >= 0) & (at < width - 1)
                    r, c = each[fits], at[fits]
                    score[r, c], joined[r, c] = self._lookup(now[r, c], now[r, c + 1])
            final = self.id_of[syms]
            odd[rows[((syms >= 0) & (final < 0)).any(axis=1)]] = True
            sizes[rows] = lens
            done.append((rows, final[np.arange(width) < lens[:, None]]))
        alone = {k: np.array(self.merge(units[k]), np.int32) for k in np.flatnonzero(odd).tolist()}
        merged = [(rows, ids[np.repeat(~odd[rows], sizes[rows])]) for rows, ids in done]
        sizes[list(alone)] = [len(x) for x in alone.values()]
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        for rows, ids in [*((rows[~odd[rows]], ids) for rows, ids in merged), *((np.array([k]), ids) for k, ids in alone.items())]:
            n = sizes[rows]
            out[np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())] = ids
        return out, sizes

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without the end id."""
        return self.merge((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else []

    def encode_column(self, texts: pa.Array, check: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the n+1 offsets of the rows in them."""
        if not self.splits:
            ids = [self.encode(t or "") for t in texts.to_pylist()]
            return np.array(list(chain.from_iterable(ids)), np.int32), np.cumsum([0, *map(len, ids)])
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        data, rows = buffers(texts)
        cut = np.ones(len(data), bool)
        cut[1:] = self.apart[data[:-1], data[1:]]
        cut[rows[:-1][np.diff(rows) > 0]] = True
        begin = np.flatnonzero(cut)
        if not len(begin):
            return np.empty(0, np.int32), np.zeros(len(rows), np.int64)
        end = np.append(begin[1:], len(data))
        bounds = np.searchsorted(begin, rows)
        hashes, first, where = np.unique(hash_words(Words(data, rows, begin, end, bounds)), return_index=True, return_inverse=True)
        if len(self.known) > MEMORY:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != hashes
        if new.any():
            units = [data[begin[k] : end[k]].tobytes().decode().replace(" ", MARK) for k in first[new]]
            ids, sizes = self.merge_many(units)
            if check:
                # A line feed is never part of a piece here, so what follows it is encoded as if it stood alone.
                expected = self.library.encode(["\n" + u for u in units], num_threads=1)
                flat, ends = ids.tolist(), np.cumsum(sizes).tolist()
                for u, begin_id, end_id, want in zip(units, [0, *ends], ends, expected, strict=False):
                    if flat[begin_id:end_id] != want[2:]:
                        raise ValueError(f"encoding of {u!r} differs from the library's")
            self.starts = np.insert(self.starts, at[new], len(self.pool) + np.cumsum(sizes) - sizes)
            self.sizes = np.insert(self.sizes, at[new], sizes)
            self.known = np.insert(self.known, at[new], hashes[new])
            self.pool = np.concatenate([self.pool, ids])
            at = np.searchsorted(self.known, hashes)
        at = at[where]
        total, flat = gather(self.pool, self.starts[at], self.sizes[at])
        return flat, total[bounds]

    def decode_column(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids that came from texts, so that their bytes are UTF-8."""
        total, data = gather(self.raw_bytes, self.raw_starts[ids], self.raw_sizes[ids])
        rows = total[offsets]
        if self.prefix and len(data):
            drop = rows[:-1][np.diff(rows) > 0]
            drop = drop[data[drop] == 0x20]
            rows = rows - np.searchsorted(drop, rows)
            data = np.delete(data, drop)
        return pa.Array.from_buffers(pa.large_string(), len(rows) - 1, [None, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; the dummy prefix goes, bytes that aren't UTF-8 become U+FFFD."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.texts.__getitem__, ids))
        else:
            text = "".join(bytes(map(self.byte_of.__getitem__, run)).decode("utf-8", "arcflow_each") if raw else "".join(map(self.texts.__getitem__, run)) for raw, run in groupby(ids, self.byte_of.__contains__))
        if self.prefix and text[:1] == " ":
            first = next((i for i in ids if i not in self.control), self.unknown)
            if first != self.unknown and first not in self.byte_of:
                text = text[1:]
        return text


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n+1 running sizes, and the pool's ranges one after another."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    return total, pool[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])]


_models: dict[int, PieceModel] = {}


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True, check: bool = True) -> DataFrame:
    """One row per document row: its id, ids array<int>, decoded string.

    `model_path` is read on the driver. With `check`, results are compared with the library's in each Arrow batch.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        model = _models.get(key) or _models.setdefault(key, PieceModel(shared.value))
        end = add_end
        for batch in batches:
            for part in slices(batch, "text"):
                ids, rows = model.encode_column(part.column("text"), check)
                texts = model.decode_column(ids, rows).cast(pa.string())
                if end:
                    ids, rows = np.insert(ids, rows[1:], model.end), rows + np.arange(len(rows))
                if check:
                    flat = ids.tolist()
                    if model.library.decode([flat[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)], num_threads=1) != texts.to_pylist():
                        raise ValueError("a decoded text differs from the library's")
                lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id").cast(schema.field("id").type), lists.cast(schema.field("ids").type), texts], schema=schema)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
