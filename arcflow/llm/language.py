"""Language identification by script ranges and Viterbi labelling of words.

Words are runs of letters of one script. The script narrows the candidates to the
languages that use it in the training rows. A word's score for a language is the sum of
the log probabilities of its character n-grams (two to four, with the word's edges), less
their mean over the languages, over the number of lengths. Viterbi finds the labelling of a text's words with the
best total, where each change of language costs `SWITCH`; runs of equal labels are the
spans. A text's language is that with most letters in its spans, and the score its share.

Learned from a bounded sample: for each language the rows whose ids hash lowest,
`SAMPLE` on average if it has more.

Defined cases: a null text, or one without a letter, is `und` with score 0 and no spans,
and so is every text if there is nothing to learn from; rows with null text, language or
id aren't learned from; words of scripts that no language uses take their neighbours'
label; ties go to the language first in order; rows of one id are learned from, or left
out, together; an empty table gives an empty table; repeated rows each give a row; texts
of any length are read whole; other columns don't matter.

Scale: one map over the documents without a shuffle. The model has
languages * ORDERS * 2^15 floats, at most `LANGUAGES` languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arcflow.llm.words import slices

UND = "und"
BITS = 15
ORDERS = (2, 3, 4)
SAMPLE = 3000
LANGUAGES = 400
SWITCH = 8.0
#: Least share of a language's letters in a script for the language to be a candidate there.
SCRIPT_SHARE = 0.01
CHUNK_BYTES = 1 << 22

# Ranges of code points by script.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x300, 0x36F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Syriac": [(0x700, 0x74F)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Oriya": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Mongolian": [(0x1800, 0x18AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its script (0: not a letter, 1: a letter of no listed script), its lower case."""
    script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for point in range(0x40000):
        if point not in range(0xD800, 0xE000):
            c = chr(point)
            if unicodedata.category(c)[0] in "LM":
                script[point] = 1
                if len(x := c.lower()) == 1:
                    lower[point] = ord(x)
    marks = [point for point in np.flatnonzero(script).tolist() if unicodedata.category(chr(point))[0] == "M"]
    for k, ranges in enumerate(SCRIPTS.values(), 2):
        for first, last in ranges:
            part = script[first : last + 1]
            part[part > 0] = k
    # A mark of no script, such as an emoji's variation selector, is no letter.
    script[[point for point in marks if script[point] == 1]] = 0
    return script, lower


class Text(NamedTuple):
    """Words of consecutive texts and the hashed n-grams that start at each code point (-1: none)."""

    starts: np.ndarray
    ends: np.ndarray
    scripts: np.ndarray
    bounds: np.ndarray
    rows: np.ndarray
    grams: list[np.ndarray]


def read(texts: list[str]) -> Text:
    script, lower = _tables()
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n" * max(ORDERS)).encode("utf-32-le"), np.uint32)
    rows = np.cumsum([1, *(len(t) + 1 for t in texts)])
    kind = script[points]
    inside = kind > 0
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = change[inside[change]]
    ends = change[inside[change - 1]]
    letters = np.where(inside, lower[points], 0).astype(np.uint64)
    grams, n = [], len(points)
    key = letters.copy()
    middle = np.ones(n, bool)
    for order in range(2, max(ORDERS) + 1):
        m = n - order + 1
        if order > 2:
            middle[:m] &= inside[order - 2 : order - 2 + m]
        key[:m] = key[:m] * np.uint64(0x100000001B3) + letters[order - 1 :]
        if order in ORDERS:
            valid = middle[:m] & (inside[:m] | inside[order - 1 :]) if order == 2 else middle[:m]
            x = key[:m] * np.uint64(0x9E3779B97F4A7C15)
            out = np.full(n, -1, np.int32)
            out[:m] = np.where(valid, (x >> np.uint64(64 - BITS)).astype(np.int32), -1)
            grams.append(out)
    return Text(starts, ends, kind[starts], np.searchsorted(starts, rows), rows, grams)


class Model(NamedTuple):
    """tables: of each language and order the centred log probabilities of buckets, and 0 for none; fits: languages by script."""

    languages: list[str]
    tables: np.ndarray
    fits: np.ndarray

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """From each language's gram counts (orders by buckets) and letters by script."""
        languages = sorted(counts)
        tables = np.zeros((len(languages), len(ORDERS), (1 << BITS) + 1), np.float32)
        fits = np.zeros((256, len(languages)), bool)
        for k, name in enumerate(languages):
            grams, letters = counts[name]
            tables[k, :, :-1] = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS)))
            fits[:, k] = letters >= SCRIPT_SHARE * max(letters.sum(), 1)
        if languages:
            tables -= tables.mean(axis=0)
        return cls(languages, tables / len(ORDERS), fits)

    def word_scores(self, text: Text) -> np.ndarray:
        """Words by languages."""
        out = np.empty((len(text.starts), len(self.languages)), np.float32)
        flags = np.zeros(len(text.grams[0]) + 1, np.int8)
        flags[text.starts] += 1
        flags[text.ends] -= 1
        edge = np.cumsum(flags[:-1]) == 0
        for k in range(len(self.languages)):
            total = self.tables[k, 0][text.grams[0]]
            for j in range(1, len(ORDERS)):
                total += self.tables[k, j][text.grams[j]]
            total[1:] += np.where(edge[:-1], total[:-1], 0)
            total[edge] = 0
            out[:, k] = np.add.reduceat(total, text.starts)
        fits = self.fits[text.scripts]
        known = fits.any(axis=1)
        out[known[:, None] & ~fits] = -1e4
        out[~known] = 0
        return out


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labelling of each row's words (`bounds`: its range in `scores`); all rows advance together."""
    n, kinds = scores.shape
    labels, best = np.zeros(n, np.int32), np.zeros(n, np.int32)
    stay = np.ones((n, kinds), bool)
    counts = np.diff(bounds)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    first, counts = bounds[:-1][order], counts[order]
    active = np.searchsorted(-counts, -np.arange(1, (counts[0] if len(counts) else 0) + 1), "right")
    value = scores[first].copy()
    for t in range(1, len(active)):
        a = active[t]
        if a < len(value):
            labels[first[a : len(value)] + t - 1] = value[a:].argmax(axis=1)
            value = value[:a]
        top = value.argmax(axis=1)
        other = value[np.arange(a), top] - switch
        at = first[:a] + t
        kept = value >= other[:, None]
        stay[at], best[at] = kept, top
        value = np.where(kept, value, other[:, None]) + scores[at]
    if len(active):
        labels[first[: len(value)] + len(active) - 1] = value.argmax(axis=1)
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        now = labels[at]
        labels[at - 1] = np.where(stay[at, now], now, best[at])
    return labels


def train(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from rows with a language and a text for which `learn`, a condition on the id column, holds."""
    rows = docs.where(learn) if learn is not None else docs
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Model.fit({})
    bound = docs.sparkSession.createDataFrame([(k, ((1 << 63) - 1) * min(n, sample) // n) for k, n in sizes.items()], "lang string, bound long")
    chosen = rows.join(F.broadcast(bound), "lang").where(F.shiftrightunsigned(F.xxhash64("id"), 1) <= F.col("bound")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for name in batch.column("lang").unique().to_pylist():
                mine = batch.filter(pc.equal(batch.column("lang"), name))
                sums = found.setdefault(name, [np.zeros((len(ORDERS), 1 << BITS), np.int64), np.zeros(256, np.int64)])
                for part in slices(mine, "text"):
                    text = read(part.column("text").to_pylist())
                    for j, grams in enumerate(text.grams):
                        sums[0][j] += np.bincount(grams[grams >= 0], minlength=1 << BITS)
                    sums[1] += np.bincount(text.scripts, text.ends - text.starts, 256).astype(np.int64)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([x.tobytes() for x, _ in found.values()]), pa.array([x.tobytes() for _, x in found.values()])], names=["lang", "grams", "letters"])

    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in chosen.repartition(len(sizes), "lang").mapInArrow(run, "lang string, grams binary, letters binary").collect():
        grams, letters = np.frombuffer(r["grams"], np.int64).reshape(len(ORDERS), -1), np.frombuffer(r["letters"], np.int64)
        old = counts.get(r["lang"], (0, 0))
        counts[r["lang"]] = (old[0] + grams, old[1] + letters)
    return Model.fit({k: v for k, v in counts.items() if v[1].sum()})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per document row: its id, lang, score, spans (code points, end exclusive, language)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    kind = docs.schema[id_col].dataType
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    schema = pa.schema([("id", to_arrow_type(kind)), ("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def label(known: Model, texts: list[str]) -> list[pa.Array]:
        n, kinds = len(texts), len(known.languages)
        text = read(texts)
        if not kinds or not len(text.starts):
            return [pa.array([UND] * n), pa.array(np.zeros(n)), pa.array([[]] * n, schema.field("spans").type)]
        labels = viterbi(known.word_scores(text), text.bounds, switch)
        row = np.repeat(np.arange(n), np.diff(text.bounds))
        letters = np.bincount(row * kinds + labels, text.ends - text.starts, n * kinds).reshape(n, kinds)
        total, top = letters.sum(axis=1), letters.argmax(axis=1)
        edge = np.flatnonzero(np.diff(row * kinds + labels, prepend=-1))
        last = np.append(edge[1:], len(row)) - 1
        names = np.array(known.languages, object)
        origin = text.rows[row[edge]]
        values = pa.StructArray.from_arrays([pa.array(text.starts[edge] - origin), pa.array(text.ends[last] - origin), pa.array(names[labels[edge]].tolist())], fields=list(span))
        offsets = pa.array(np.searchsorted(row[edge], np.arange(n + 1)).astype(np.int32))
        return [pa.array(np.where(total > 0, names[top], UND).tolist()), pa.array(np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0)), pa.ListArray.from_arrays(offsets, values)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        limit = max(1 << 16, CHUNK_BYTES * 8 // max(8, len(known.languages)))
        for batch in batches:
            for part in slices(batch, "text", limit):
                columns = label(known, [t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id").cast(schema.field("id").type), *columns], schema=schema)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, lang string, score double, spans array<struct<begin:long,end:long,lang:string>>").withColumnRenamed("id", id_col)
