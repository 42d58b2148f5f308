"""Language-model scores by Katz backoff from word pairs to words.

Tokens are A-Z lower-cased words and one end for each text. The model's lower order is
P(w) = (c(w) + 1) / (N + V + 1), in which one share is for all unknown words. Its higher
order is P(w | v) = d(c) * c / t(v) for pairs seen c = c(v, w) times in training, with
Good-Turing discounts d for counts up to `TOP`, and a(v) * P(w) for the rest, where a(v)
makes the sum over all words, the unknown one included, exactly 1. t(v) is c(v), and one
more if all pairs of v are seen more than `TOP` times, so that something is left for the
rest. A text's first token has no context, and a context that isn't in training has a = 1.
Where counts of counts are too uneven for that, see `discounts`.

The model's tables are partitioned by ranges of word hashes and stored in the checkpoint
folder: words with their counts, contexts with their sums, and the pair counts that each
part of the documents asked for. Documents are dealt to parts. A part sends its distinct
words and pairs once, with their training counts, to the ranges of their last words; the
ranges merge the counts and answer in the order of the question; sums over a context's
pairs go to the context's range, which returns a(v). See `exchange`. Words that hold a
large share of all tokens are counted first; their pairs are dealt over all ranges.

Defined cases: a null or wordless text is one end; without training rows all tokens are
unknown and P(w) = 1; a repeated row is scored, and learned from, each time; rows whose
`learn` is null aren't learned from; an empty table gives an empty table; other columns
don't matter.

Scale: what every shuffle sends is linear in the input, in packs whose number grows with the
square of the parts: packed texts twice, distinct words and pairs of parts, and contexts' sums. Only a few counts for each range, and those of at most
2 * HOT frequent words for each range, go to the driver. A part is
held in one task's memory at 8 bytes for each of its tokens and 8 for each distinct pair, and what
is worked out for each token is for `PIECE` tokens at a time; so partitions are to be
sized for that, as for any sort.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcflow.llm.exchange import NULL_ID, ROWS, Parts, bundles, by_group, destinations, numbered, open_bundle, pack, run_parts, steps, stream, total, unpack
from arcflow.llm.words import LOWER, SLICE_BYTES, buffers, hash_words, mix, slices, split
from arcflow.plans.cut import cut

TOP = 5
#: A word is frequent if it has this part of a range's share of all tokens.
HOT = 4
END = np.uint64(0x5851F42D4C957F2D)
#: Tokens that are sorted or scored at a time.
PIECE = 1 << 18
# Kinds of rows, in the order in which a task needs them.
COUNTS, BACKOFFS, SUMS, WORDS, STATS, TEXTS = range(6)


class Tokens(NamedTuple):
    """A part's documents: ids, training flags, n+1 token offsets; tokens as places among its distinct words; pairs as places among its distinct pairs (-1 at a text's first token)."""

    ids: np.ndarray
    learned: np.ndarray
    bounds: np.ndarray
    words: np.ndarray
    token: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray


def places(pieces: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of all pieces in order, and the place of each value among them. Only a piece, and what is distinct, is sorted at once."""
    own, at = [], []
    for x in pieces:
        distinct, place = np.unique(x, return_inverse=True)
        own.append(distinct)
        at.append(place.astype(np.int32))
    if not own:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    values = np.unique(np.concatenate(own))
    for k, distinct in enumerate(own):
        at[k], own[k] = np.searchsorted(values, distinct).astype(np.int32)[at[k]], None
    return values, np.concatenate(at)


def read_part(texts: list[bytes]) -> Tokens:
    """Pairs are numbered by last word, then by context."""
    ids, flags, counts = [], [], []

    def hashes() -> Iterator[np.ndarray]:
        for data in texts:
            for t in open_bundle(data, SLICE_BYTES):
                words = split(LOWER[t.raw], t.at)
                counts.append(words.counts + 1)
                ids.append(t.ids)
                flags.append(t.flags)
                yield np.insert(hash_words(words), words.bounds[1:], END)

    words, token = places(hashes())
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    inner = np.ones(len(token), bool)
    inner[bounds[:-1]] = False

    def keys() -> Iterator[np.ndarray]:
        for a in range(1, len(token), PIECE):
            last, context = token[a : a + PIECE], token[a - 1 : a - 1 + PIECE]
            yield (last * np.int64(len(words)) + context[: len(last)])[inner[a : a + PIECE]]

    pairs, where = places(keys())
    pair = np.full(len(token), -1, np.int32)
    pair[inner] = where
    return Tokens(np.concatenate(ids), np.concatenate(flags).astype(bool), bounds, words, token, pairs, pair)


def discounts(seen: np.ndarray) -> np.ndarray:
    """d(0..TOP) from the numbers of pairs seen 1..TOP+1 times (`seen[1:]`); d(0) is unused.

    Good-Turing with Katz's correction; if that leaves a discount outside (0, 1), the same from
    the numbers' log-linear fit; if they don't fall steeply enough for that, absolute discounts.
    """
    k = np.arange(1, TOP + 1)
    n = seen.astype(float)

    def turing(n: np.ndarray) -> np.ndarray | None:
        if not (n[1:] > 0).all() or (last := (TOP + 1) * n[TOP + 1] / n[1]) >= 1:
            return None
        found = ((k + 1) * n[k + 1] / (k * n[k]) - last) / (1 - last)
        return found if ((found > 0) & (found < 1)).all() else None

    found = turing(n)
    if found is None and (n[1:] > 0).all():
        at = np.log(np.arange(1, TOP + 2))
        slope, level = np.polyfit(at, np.log(n[1:]), 1)
        found = turing(np.concatenate(([0.0], np.exp(level + slope * at))))
    if found is None:
        share = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        found = (k - share) / k
    return np.concatenate(([1.0], found))


class Hot(NamedTuple):
    """Frequent words in order, and their training counts."""

    words: np.ndarray
    counts: np.ndarray

    def index(self, words: np.ndarray) -> np.ndarray:
        """Place of each word among the frequent, or -1."""
        if not len(self.words):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


def _hashed(part: pa.RecordBatch) -> np.ndarray:
    """All tokens of a slice."""
    data, rows = buffers(part.column("text"))
    words = split(LOWER[data], rows)
    return np.insert(hash_words(words), words.bounds[1:], END)


def frequent_words(rows: DataFrame, ranges: int) -> Hot:
    """Words with about 1 / (HOT * ranges) of all tokens or more; at most 2 * HOT * ranges.

    A word with a share has it in at least one task, so tasks name their frequent words first; then those are counted exactly.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, n = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = _hashed(part)
                n += len(tokens)
                w, c = np.unique(tokens, return_counts=True)
                merged, where = np.unique(np.concatenate([words, w]), return_inverse=True)
                words, counts = merged, np.bincount(where, np.concatenate([counts, c])).astype(np.int64)
        if n:
            some = counts * HOT * ranges >= n
            yield pa.RecordBatch.from_pydict({"word": np.append(words[some], END).view(np.int64), "n": np.append(counts[some], 0), "tokens": np.append(np.zeros(some.sum(), np.int64), n)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(names), np.int64)
        for batch in batches:
            for part in slices(batch.filter(batch.column("learned")), "text"):
                at = hot.index(_hashed(part))
                totals += np.bincount(at[at >= 0], minlength=len(names))
        yield pa.RecordBatch.from_pydict({"word": names.view(np.int64), "n": totals})

    named = cut(rows.select("text").mapInArrow(name, "word long, n long, tokens long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")))
    total_tokens = named.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    names = np.sort(np.array([r["word"] for r in named.where(F.col("n") * 2 * HOT * ranges >= total_tokens).collect()], np.int64).view(np.uint64)) if total_tokens else np.empty(0, np.uint64)
    hot = Hot(names, np.zeros(len(names), np.int64))
    if not len(names):
        return hot
    found = {r["word"]: r["n"] for r in rows.select("text", "learned").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return Hot(names, np.array([found.get(w, 0) for w in names.view(np.int64).tolist()], np.int64))


class Layout(NamedTuple):
    """How a part's pairs are told to the ranges: order of the pairs, ends of each range's in it, first of its frequent words' among them."""

    order: np.ndarray
    ends: np.ndarray
    hot: np.ndarray


def layout(t: Tokens, parts: Parts, hot: Hot) -> Layout:
    """Pairs go to the range of their last word; those of a frequent word to ranges by pair."""
    last, context = np.divmod(t.pairs, len(t.words))
    frequent = hot.index(t.words)[last] >= 0
    target = parts.of_range(np.where(frequent, mix(t.words[last] * np.uint64(3) + t.words[context]), t.words[last]))
    order = np.lexsort((frequent, target))
    ends = np.searchsorted(target[order], np.arange(parts.count + 1))
    return Layout(order, ends, ends[:-1] + np.bincount(target[~frequent], minlength=parts.count))


def _ask(parts: Parts, shared):
    number = {int(n): k for k, n in enumerate(parts.numbers)}

    def part(rows: Iterator[tuple[int, bytes]], dest: int) -> Iterator[tuple[int, int, bytes]]:
        t, hot = read_part([data for _, data in rows]), Hot(*shared.value)
        size = len(t.words)
        learned = np.repeat(t.learned, np.diff(t.bounds))
        counts = np.bincount(t.token[learned], minlength=size).astype(np.uint32)
        pair_counts = np.bincount(t.pair[learned & (t.pair >= 0)], minlength=len(t.pairs)).astype(np.uint32)
        last, context = np.divmod(t.pairs, size)
        way = layout(t, parts, hot)
        edges = np.searchsorted(parts.of_range(t.words), np.arange(parts.count + 1))
        place = hot.index(t.words)
        for k in range(parts.count):
            s, cold, warm = slice(int(edges[k]), int(edges[k + 1])), way.order[way.ends[k] : way.hot[k]], way.order[way.hot[k] : way.ends[k + 1]]
            if s.start == s.stop and not len(warm):
                continue
            each = np.bincount(last[cold] - s.start, minlength=s.stop - s.start).astype(np.uint32)
            contexts, at = np.unique(context[np.concatenate([cold, warm])], return_inverse=True)
            named, often = np.unique(place[last[warm]], return_counts=True)
            yield int(parts.numbers[k]), WORDS, pack(np.array([number[dest]]), steps(t.words[s]), counts[s], each, steps(t.words[contexts]), at.astype(np.uint32), pair_counts[np.concatenate([cold, warm])], named.astype(np.uint32), often.astype(np.uint32))

    return part


def _merge(parts: Parts, shared):
    number = {int(n): k for k, n in enumerate(parts.numbers)}

    def part(rows: Iterator[tuple[int, bytes]], dest: int) -> Iterator[tuple[int, int, bytes]]:
        hot = Hot(*shared.value)
        here = np.array([number[dest]])
        got = [unpack(data) for _, data in rows]
        owners = [int(g[0][0]) for g in got]
        lists, context_lists = [total(g[1]) for g in got], [total(g[4]) for g in got]
        words, place = places(lists)
        ends, cut_at = (np.concatenate(([0], np.cumsum([len(g[k]) for g in got]))).tolist() for k in (1, 6))
        contexts = np.unique(np.concatenate(context_lists))

        def keys() -> Iterator[np.ndarray]:
            for k, g in enumerate(got):
                last = np.concatenate([np.repeat(place[ends[k] : ends[k + 1]], g[3]), len(words) + np.repeat(g[7].astype(np.int64), g[8])])
                yield last * np.int64(max(1, len(contexts))) + np.searchsorted(contexts, context_lists[k])[g[5]]

        pairs, where = places(keys())
        # A part names each word and pair once.
        counts, pair_counts = np.zeros(len(words), np.int64), np.zeros(len(pairs), np.int64)
        for k, g in enumerate(got):
            counts[place[ends[k] : ends[k + 1]]] += g[2]
            pair_counts[where[cut_at[k] : cut_at[k + 1]]] += g[6]
        del got, context_lists
        begin = 0
        for k, (owner, mine) in enumerate(zip(owners, lists, strict=True)):
            at = place[begin : begin + len(mine)]
            begin += len(mine)
            yield int(parts.numbers[owner]), COUNTS, pack(here, counts[at].astype(np.uint32), pair_counts[where[cut_at[k] : cut_at[k + 1]]].astype(np.uint32))
            # The same words are contexts; their range keeps who has them.
            yield dest, BACKOFFS, pack(np.array([owner]), steps(at.astype(np.uint32)))
        yield dest, WORDS, pack(steps(words), counts.astype(np.uint64))
        seen = pair_counts > 0
        last, context = np.divmod(pairs[seen], max(1, len(contexts)))
        found = pair_counts[seen]
        yield dest, STATS, pack(np.array([counts.sum(), (counts > 0).sum(), *np.bincount(np.minimum(found, TOP + 2), minlength=TOP + 3)[1 : TOP + 2]]))
        order = np.argsort(context, kind="stable")
        context, found, weight = context[order], found[order], np.concatenate([counts, hot.counts])[last][order] + 1
        first = np.flatnonzero(np.diff(context, prepend=-1))
        if not len(first):
            return
        ids = contexts[context[first]]
        add = lambda x: np.add.reduceat(x.astype(np.int64), first)
        sums = [*(add(found == k) for k in range(1, TOP + 1)), add(np.where(found > TOP, found, 0)), add(weight)]
        for k, s in by_group(parts.of_range(ids), parts.count):
            yield int(parts.numbers[k]), SUMS, pack(steps(ids[s]), *(x[s].astype(np.uint32) for x in sums[:-1]), sums[-1][s])

    return part


class Stats(NamedTuple):
    tokens: int
    distinct: int
    discount: np.ndarray


def _back_off(parts: Parts, stats: Stats):
    """a(v) of each part's words in a range; negative where t(v) is c(v) + 1."""
    number = {int(n): k for k, n in enumerate(parts.numbers)}

    def part(rows: Iterator[tuple[int, bytes]], dest: int) -> Iterator[tuple[int, int, bytes]]:
        owners, sums, words, counts = [], [], np.empty(0, np.uint64), np.empty(0, np.int64)
        for kind, data in rows:
            got = unpack(data)
            if kind == BACKOFFS:
                owners.append((int(got[0][0]), total(got[1])))
            elif kind == SUMS:
                sums.append([total(got[0]), *got[1:]])
            elif kind == WORDS:
                words, counts = total(got[0]), got[1].astype(np.int64)
        alpha = np.ones(len(words))
        if sums:
            at = np.searchsorted(words, np.concatenate([x[0] for x in sums]))
            held = [np.bincount(at, np.concatenate([x[k] for x in sums]), len(words)) for k in range(1, TOP + 3)]
            few = sum(held[:TOP])
            some = (few + held[TOP]) > 0
            extra = some & (few == 0)
            mass = (sum(held[k - 1] * k * stats.discount[k] for k in range(1, TOP + 1)) + held[TOP]) / np.maximum(counts + extra, 1)
            lower = held[TOP + 1] / (stats.tokens + stats.distinct + 1)
            alpha = np.where(some, (1 - mass) / (1 - lower), 1.0) * np.where(extra, -1, 1)
        for owner, mine in owners:
            yield int(parts.numbers[owner]), BACKOFFS, pack(np.array([number[dest]]), alpha[mine])

    return part


def _in_order(rows: list[list[np.ndarray]], column: int) -> np.ndarray:
    return np.concatenate([x[column] for x in sorted(rows, key=lambda x: int(x[0][0]))])


def token_scores(t: Tokens, counts: np.ndarray, pair_counts: np.ndarray, alpha: np.ndarray, stats: Stats) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token by the lower order and by the model."""
    lower = np.log10((counts + 1) / (stats.tokens + stats.distinct + 1))[t.token]
    context = np.concatenate(([0], t.token[:-1]))
    seen = np.where(t.pair >= 0, pair_counts[t.pair], 0) if len(pair_counts) else np.zeros(len(t.token), np.int64)
    held = np.maximum(counts[context] + (alpha[context] < 0), 1)
    discount = np.append(stats.discount, 1.0)[np.minimum(seen, TOP + 1)]
    own = np.log10(np.maximum(discount * seen, 1e-300) / held)
    return lower, np.where(seen > 0, own, np.where(t.pair >= 0, np.log10(np.abs(alpha[context])) + lower, lower))


def scored(t: Tokens, counts: np.ndarray, pair_counts: np.ndarray, alpha: np.ndarray, stats: Stats) -> Iterator[tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents at a time, of about `PIECE` tokens, with each one's known tokens and sums of `token_scores`."""
    a = 0
    while a < len(t.ids):
        b = max(a + 1, int(np.searchsorted(t.bounds, t.bounds[a] + PIECE, "right")) - 1)
        s = slice(int(t.bounds[a]), int(t.bounds[b]))
        some = t._replace(ids=t.ids[a:b], learned=t.learned[a:b], bounds=t.bounds[a : b + 1] - t.bounds[a], token=t.token[s], pair=t.pair[s])
        base, score = token_scores(some, counts, pair_counts, alpha, stats)
        begin = some.bounds[:-1]
        yield some, np.add.reduceat((counts[some.token] > 0).astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(score, begin)
        a = b


def score_documents(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id, learned, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Learned from the rows for which `learn`, a condition on the columns of `docs`, holds; from all without one.
    """
    parts = Parts(docs.sparkSession)
    flag = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    rows = numbered(docs, parts, id_col, text_col, flag.alias("learned"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(frequent_words(rows, parts.count)))
    texts = bundles(rows, parts, TEXTS, "learned")
    tables = cut(parts.deal(parts.deal(texts).mapInArrow(run_parts(_ask(parts, shared)), ROWS)).mapInArrow(run_parts(_merge(parts, shared)), ROWS))
    sums = [unpack(r["data"])[0] for r in tables.where(F.col("kind") == STATS).select("data").collect()]
    sums = np.sum(sums, axis=0) if sums else np.zeros(TOP + 3, np.int64)
    stats = Stats(int(sums[0]), int(sums[1]), discounts(np.concatenate(([0], sums[2:]))))
    alphas = parts.deal(tables.where(F.col("kind").isin(BACKOFFS, SUMS, WORDS))).mapInArrow(run_parts(_back_off(parts, stats)), ROWS)
    schema = pa.schema([("id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in destinations(stream(batches)):
            held: dict[int, list] = {COUNTS: [], BACKOFFS: [], TEXTS: []}
            for kind, data in rows:
                held[kind].append(data if kind == TEXTS else unpack(data))
            if not held[TEXTS]:
                continue
            t = read_part(held.pop(TEXTS))
            counts = _in_order(held[COUNTS], 1).astype(np.int64)
            pair_counts = np.empty(len(t.pairs), np.int64)
            pair_counts[layout(t, parts, Hot(*shared.value)).order] = _in_order(held[COUNTS], 2)
            alpha = _in_order(held[BACKOFFS], 1)
            held.clear()
            for x, known, base, score in scored(t, counts, pair_counts, alpha, stats):
                yield pa.RecordBatch.from_arrays([pa.array(x.ids, pa.int64(), mask=x.ids == NULL_ID), pa.array(x.learned), pa.array(np.diff(x.bounds)), pa.array(known), pa.array(np.full(len(x.ids), stats.tokens)), pa.array(base), pa.array(score)], schema=schema)

    told = tables.where(F.col("kind") == COUNTS).unionByName(alphas).unionByName(texts)
    done = parts.deal(told).mapInArrow(finish, "id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
