"""Word splitting and hashing on whole Arrow batches.

All text operators see a batch as one UTF-8 byte buffer plus row offsets, so that
splitting and hashing are array operations without a Python loop over words.
Nulls are empty texts. Batches are cut at row boundaries into slices of about
`SLICE_BYTES`, which bounds the working memory; a single longer text is a slice
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
#: Space and the controls from tab to carriage return separate words.
WHITE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Lower-cased ASCII letters and digits and every non-ASCII byte stay; the rest become spaces.
NORMAL = np.where((_BYTES < 0x30) | ((_BYTES > 0x39) & (_BYTES < 0x41)) | ((_BYTES > 0x5A) & (_BYTES < 0x61)) | ((_BYTES > 0x7A) & (_BYTES < 0x80)), 0x20, LOWER).astype(np.uint8)
NORMAL_TABLE = NORMAL.tobytes()

#: Odd 64-bit multipliers of the two independent hash families.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEEDS = (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ np.uint64(seed)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        have = tables[0], tables[1]
        if size <= 1 << 22:
            _powers[base] = have
    return have


class Words(NamedTuple):
    """Words of consecutive rows: byte ranges, and for each row the range of its words."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 offsets of the rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about `limit` bytes; a longer text is alone in its part."""
    if batch.num_rows == 0:
        return
    _, offsets = buffers(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def split(data: np.ndarray, rows: np.ndarray, white: np.ndarray = WHITE) -> Words:
    """Maximal runs of bytes that aren't white; they don't cross rows."""
    inside = ~white[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    before[rows] = False
    after[rows] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, rows, starts, ends, np.searchsorted(starts, rows))


def hash_words(words: Words, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal for equal words in every batch."""
    base, n = BASES[family], len(words.data)
    if not len(words.starts):
        return np.empty(0, np.uint64)
    up, down = _power_table(base, n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    values = (sums[words.ends] - sums[words.starts]) * down[words.starts]
    return mix(values, SEEDS[family])


def hash_windows(hashes: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """Hash of the `size` consecutive word hashes from each position; the last size-1 positions are absent."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, done, block, width, total = BASES[1 - family], 0, hashes, 1, None
    while True:
        if size & width:
            part = block[done : done + n]
            total = part.copy() if total is None else total + part * np.uint64(pow(base, done, 1 << 64))
            done += width
        if done == size:
            return mix(total, SEEDS[1 - family] ^ size)
        block = block[:-width] + block[width:] * np.uint64(pow(base, width, 1 << 64))
        width *= 2


def window_rows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in all words at which a window of `size` words of one row starts; their rows; windows of each row."""
    counts = np.maximum(words.counts - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - first[rows] + words.bounds[:-1][rows], rows, counts
