"""Toxicity scores by a factorization machine over hashed terms.

Terms are A-Z lower-cased words (ASCII letters and digits and all non-ASCII characters),
hashed to 2^18 buckets; a text is the set of its buckets. The model has a bias, a weight
for each term and a vector of `FACTORS` for each term, whose products add what pairs of
terms say beyond their weights. Learned are the `TERMS` buckets that are most unlike
between the classes in the training rows (by z-score of their document shares), and all
buckets of a telling pair, however neutral each is by itself: pairs whose rows together
are off what the model of the first says by more than chance gives the greatest of all
pairs. Pairs are told from terms that at least `PAIR_SHARE` of the rows have. Other terms
have no weight. The loss is the log loss with a quadratic penalty.

Training takes a bounded sample of labelled rows: all if there are at most `SAMPLE`,
else those whose id hashes lowest, in that number on average. All else covers all rows.

Defined cases: a null or wordless text has the bias's score; labels other than 0 and 1,
null ids and labels without a document are not learned from; of repeated labels of one id
the highest counts; of terms equally unlike between the classes the smaller bucket is
taken; texts of any length are read whole; without rows of both classes every score is the mean label (0.0 if
there is none); an empty table gives an empty table; other columns don't matter.

Scale: one map over the documents, whose other columns stay where they are; the model
broadcast is at most 2^18 * (FACTORS + 2) * 4 bytes, whatever the data. To the driver go
two counts for each of 2^18 buckets, and of the sample the terms that may be learned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcflow.llm.words import LOWER, NORMAL, buffers, hash_words, mix, slices, split
from arcflow.plans.cut import collect_garbage, cut

BITS = 18
TERMS = 1024
FACTORS = 8
SAMPLE = 20_000
STEPS = 250
#: Share of the rows that terms of pairs have.
PAIR_SHARE = 0.01
#: Terms whose pairs are counted together, and rows taken together, so that the driver holds little beside the sample's terms.
PAIR_BLOCK = 256
ROWS = 1000
PENALTY = 2e-3

_APART = NORMAL == 0x20


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each row in order, and the n+1 offsets of the rows in them."""
    data, rows = buffers(column)
    words = split(LOWER[data], rows, _APART)
    key = np.unique((words.row_of().astype(np.int64) << BITS) | (hash_words(words) >> np.uint64(64 - BITS)).astype(np.int64))
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(rows)))


class Model(NamedTuple):
    """place: for each bucket its row in weights and factors, or -1."""

    bias: float
    place: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = self.place[found]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at >= 0]
        at = at[at >= 0]
        n = len(offsets) - 1
        raw = self.bias + np.bincount(owner, self.weights[at], n)
        for k in range(self.factors.shape[1]):
            v = self.factors[at, k]
            raw += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def gradient(x: np.ndarray, y: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope of the mean log loss plus penalty * (|weights|^2 / 20 + |factors|^2 / 2): by each row's raw score, by weights and by factors."""
    sums = x @ factors
    raw = bias + x @ weights + 0.5 * ((sums**2).sum(axis=1) - x @ (factors**2).sum(axis=1))
    error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y) / len(y)
    push = x.T @ error
    return error, push + penalty * weights / 10, x.T @ (error[:, None] * sums) - push[:, None] * factors + penalty * factors


def telling_terms(ones: np.ndarray, every: np.ndarray, n: int, toxic: int, n_terms: int) -> np.ndarray:
    """Buckets most unlike between the classes, by counts in toxic rows and in all; the smaller bucket first among equals."""
    share = every / n
    z = (ones - toxic * share) / np.sqrt(np.maximum(toxic * share * (1 - share), 1e-9) + 1)
    z[every < 3] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:n_terms]
    return np.sort(chosen[z[chosen] != 0])


def frequent_terms(every: np.ndarray, n: int) -> np.ndarray:
    """Buckets in enough rows for their pairs to be told."""
    return np.flatnonzero(every >= max(10, PAIR_SHARE * n))


def _pieces(place: np.ndarray, found: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of some rows at a time: the first, and places of their terms with the rows, from it on, that have them; terms without a place are left out."""
    for first in range(0, len(offsets) - 1, ROWS):
        ends = offsets[first : first + ROWS + 1]
        at = place[found[ends[0] : ends[-1]]]
        owner = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
        yield first, at[at >= 0], owner[at >= 0]


def telling_pairs(found: np.ndarray, offsets: np.ndarray, error: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Buckets of `of` in pairs whose rows' errors add up to more than chance gives the greatest of all pairs; rows with the same terms count once."""
    place = np.full(1 << BITS, -1, np.int32)
    place[of] = np.arange(len(of))
    whole, kept = np.zeros(len(error)), []
    for first, at, owner in _pieces(place, found, offsets):
        whole[first : first + ROWS] = np.bincount(owner, mix(at.astype(np.uint64), 5).astype(np.float64), min(ROWS, len(error) - first))
    _, single = np.unique(np.stack([whole, error.round(6)]), axis=1, return_index=True)
    row = np.full(len(error), -1, np.int32)
    row[single] = np.arange(len(single))
    for first, at, owner in _pieces(place, found, offsets):
        owner = row[first + owner]
        kept.append((at[owner >= 0], owner[owner >= 0]))
    at, owner = (np.concatenate(x) for x in zip(*kept, strict=True))
    del kept
    rows = owner[np.argsort(at, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(of)))])
    del at, owner
    error = error[single].astype(np.float32)
    limit = np.sqrt(2 * np.log(max(2, len(of) * (len(of) - 1) / 2))) + 1
    told = np.zeros(len(of), bool)
    sums = np.concatenate([[0], np.cumsum(error[rows], dtype=np.float64)])
    own = ((sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(np.diff(ends), 1)).astype(np.float32)
    mean = error.mean()

    def block(first: int) -> np.ndarray:
        last = min(first + PAIR_BLOCK, len(of))
        out = np.zeros((len(error), last - first), np.float32)
        out[rows[ends[first] : ends[last]], np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))] = 1
        return out

    for a in range(0, len(of), PAIR_BLOCK):
        left = block(a)
        off, spread = left * error[:, None], left * error[:, None] ** 2
        for b in range(a, len(of), PAIR_BLOCK):
            right = left if a == b else block(b)
            # What the two terms' own rows are off by is not the pair's.
            alone = own[a : a + left.shape[1], None] + own[None, b : b + right.shape[1]] - mean
            z = np.abs(off.T @ right - (left.T @ right) * alone) / np.sqrt(np.maximum(spread.T @ right, 1.0))
            if a == b:
                np.fill_diagonal(z, 0)
            one, other = np.nonzero(z > limit)
            told[a + one], told[b + other] = True, True
    return of[told]


def fit(found: np.ndarray, offsets: np.ndarray, labels: np.ndarray, n_terms: int = TERMS, n_factors: int = FACTORS, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """Fit on rows of distinct hashed terms with labels 0 and 1: on the terms most unlike between the classes, and again with those of telling pairs if there are any."""
    n, toxic = len(labels), labels == 1
    if not n or toxic.all() or not toxic.any():
        mean = float(labels.mean()) if n else 0.0
        bias = np.log(mean / (1 - mean)) if 0 < mean < 1 else (40.0 if mean else -40.0)
        return Model(float(bias), np.full(1 << BITS, -1, np.int32), np.empty(0, np.float32), np.empty((0, n_factors), np.float32))
    ones = np.bincount(found[np.repeat(toxic, np.diff(offsets))], minlength=1 << BITS)
    every = np.bincount(found, minlength=1 << BITS)
    chosen = telling_terms(ones, every, n, int(toxic.sum()), n_terms)
    model = _fit_terms(found, offsets, labels, chosen, n_factors, steps, penalty)
    scores = np.concatenate([model.scores(found[offsets[k] : offsets[min(k + ROWS, n)]], offsets[k : k + ROWS + 1] - offsets[k]) for k in range(0, n, ROWS)])
    pairs = telling_pairs(found, offsets, labels - scores, frequent_terms(every, n))
    more = np.union1d(chosen, pairs)
    return model if len(more) == len(chosen) else _fit_terms(found, offsets, labels, more, n_factors, steps, penalty)


def _fit_terms(found: np.ndarray, offsets: np.ndarray, labels: np.ndarray, chosen: np.ndarray, n_factors: int, steps: int, penalty: float) -> Model:
    n, place = len(labels), np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    for first, at, owner in _pieces(place, found, offsets):
        x[first + owner, at] = 1
    y = labels.astype(np.float32)
    rng = np.random.default_rng(7)
    mean = y.mean()
    bias, weights, factors = np.float32(np.log(mean / (1 - mean))), np.zeros(len(chosen), np.float32), rng.normal(0, 0.05, (len(chosen), n_factors)).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (weights, factors)]
    for step in range(1, steps + 1):
        error, *slopes = gradient(x, y, bias, weights, factors, penalty)
        rate = 0.05 if step <= steps * 0.7 else 0.01
        for value, slope, (m, v) in zip((weights, factors), slopes, moments, strict=True):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        bias -= np.float32(2.0 * error.sum())
    return Model(float(bias), place, weights, factors)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows; `learn` is a condition on the id column, on which labels are left out if it doesn't hold."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.where(learn) if learn is not None else marked
    marked = marked.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    total = marked.count()
    hashed = F.shiftrightunsigned(F.xxhash64("id"), 1)
    if total > sample:
        marked = marked.where(hashed < F.lit(((1 << 63) - 1) * sample // total))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if total > sample:
        texts = texts.where(hashed < F.lit(((1 << 63) - 1) * sample // total))
    rows = texts.join(marked, "id").select("id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, offsets = terms(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("label").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found))], names=["id", "label", "found"])

    # The sample's terms are counted on the executors; only the chosen ones leave them.
    found = cut(rows.mapInArrow(run, "id string, label int, found array<int>"))
    counts = found.select(F.explode("found").alias("term"), "label").groupBy("term").agg(F.count(F.lit(1)).alias("every"), F.sum("label").alias("ones")).toArrow()
    sizes = found.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    if not sizes["n"]:
        return fit(np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0))
    every, ones = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    at = counts.column("term").to_numpy()
    every[at], ones[at] = counts.column("every").to_numpy(), counts.column("ones").to_numpy()
    chosen = np.union1d(telling_terms(ones, every, sizes["n"], sizes["toxic"], TERMS), frequent_terms(every, sizes["n"]))
    got = found.select("id", "label", F.array_intersect("found", F.lit(chosen.tolist()).cast("array<int>")).alias("found")).toArrow()
    got = got.combine_chunks().sort_by([("id", "ascending"), ("label", "ascending")])
    lists = got.column("found").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    collect_garbage(docs.sparkSession, now=True)  # the driver's Python needs memory next
    return fit(flat, offsets - offsets[0], got.column("label").to_numpy())


def scorer(spark: SparkSession, model: Model, threshold: float = 0.3) -> Callable[[Column], Column]:
    """A function of a text column: score in [0, 1], predicted (1 if score >= threshold)."""
    shared = spark.sparkContext.broadcast(tuple(model))

    def run(texts: pa.Array) -> pa.Array:
        known = Model(*shared.value)
        score = np.concatenate([np.empty(0), *(known.scores(*terms(part.column("text"))) for part in slices(pa.record_batch({"text": texts}), "text"))])
        return pa.StructArray.from_arrays([pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["score", "predicted"])

    return F.arrow_udf(run, "score double, predicted int")


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document row: its id, score in [0, 1], predicted (1 if score >= threshold)."""
    said = scorer(docs.sparkSession, model, threshold)(F.col(text_col)).alias("said")
    return docs.select(F.col(id_col).alias("id"), said).select(F.col("id").alias(id_col), "said.score", "said.predicted")
