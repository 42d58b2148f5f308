"""Spelling variants: words within one edit of each other, and the form that each rare word goes back to.

Aho-Corasick halves: of two words one edit apart, one half of the shorter is whole in the
other, as its beginning or as its end. Every word's two segments are dealt to the shards of
an automaton, and every word is scanned in each shard that may hold one of its segments. A
hit counts if it lies where the segment lies in its own word, from the beginning or from the
end, and the lengths differ by one at most; then the distance is verified.

A segment that more than `GROUP` words of one length share is taken on: one half of what is
left of such a word is whole too, so the segment is replaced by two longer ones (a beginning
and an end together), until few words share one or a single character is left, where all
that share it are near in fact. Words that look for a common segment are dealt over several
shards, each with the segment's few owners. So no shard grows with a group, nothing is
capped, and work is in proportion to the words and to the links found.

Words are maximal runs of ASCII letters and U+00C0 to U+00FF of at least `min_length` code
points, A-Z lower-cased. If `every` divides the CRC-32 h of `<doc_id>:<run>`, the code point
h modulo length is deleted from the run: typing errors by rule, of which the right forms are known.

Defined cases: a null or wordless text has no words; a null id is an empty string in what is
hashed; repeated rows count each; of near words with the same count the smallest in code
point order is the form; texts and words may have any length; an empty table gives an empty
table; columns other than the named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcflow.plans.cut import cut
from arcflow.plans.spread import join_counted

MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is this many times as frequent as the words that go back to it.
RATIO = 5
EVERY = 199
#: Words of one length that share a segment before it is replaced by longer ones.
GROUP = 128
#: Words that look for one segment in one shard.
LOOKING = 50_000
#: Segments in one shard's automaton, about.
SHARD = 200_000
#: Pairs verified together.
CHUNK = 1 << 15
#: Words up to this length are compared as rows of an array, longer ones one by one.
WIDE = 64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): words of the whole texts and their occurrences, `min_count` at least. Counts are summed in each task before they are sent on."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    rows = rows.select("_id", F.translate("_run", _UPPER, _UPPER.lower()).alias("_run"))
    hashed = F.crc32(F.concat("_id", F.lit(":"), "_run"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    less = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.length("_run")))
    words = rows.select("_run", hashed.alias("_h")).select(F.when(F.col("_h") % every == 0, less).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _key(own: str, head: str, tail: str) -> Column:
    """Names a segment: the length of the words that own it, and their beginning and end, of `head` and `tail` code points."""
    return F.concat_ws("\0", own, head, tail, F.col("word").substr(F.lit(1), F.col(head)), F.when(F.col(tail) > 0, F.col("word").substr(F.length("word") - F.col(tail) + 1, F.col(tail))).otherwise(F.lit("")))


def _segments(rows: DataFrame, head: Column, tail: Column) -> DataFrame:
    """Rows (word, n, looks, own) with each of two segments: the first half of what is between head and tail, and the second."""
    gap = F.col("own") - head - tail
    half = F.floor(gap / 2).cast("int")
    halves = F.array(F.struct((head + half).alias("head"), tail.alias("tail")), F.struct(head.alias("head"), (tail + gap - half).alias("tail")))
    return rows.withColumn("_half", F.explode(halves)).select("word", "n", "looks", "own", "_half.head", "_half.tail").withColumn("key", _key("own", "head", "tail"))


def _placed(words: DataFrame, group: int) -> DataFrame:
    """(word, n, looks, own, head, tail, key, sub): owners of segments, and words that look for segments of owners as long or one shorter.
    Segments that only their owner looks for are left out."""
    length = F.length("word")
    owners = words.select("word", "n", F.lit(False).alias("looks"), length.alias("own"))
    looking = words.select("word", "n", F.lit(True).alias("looks"), F.explode(F.array(length, length - 1)).alias("own"))
    rows, done = _segments(owners.unionByName(looking), F.lit(0), F.lit(0)), None
    while True:
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("looks")).alias("owners")).where("owners > 0 and rows > 2")
        met = cut(join_counted(rows, cut(counts), ["key"], "rows", ["word", "looks"]))
        many = (F.col("owners") > group) & (F.col("own") - F.col("head") - F.col("tail") > 1)
        few = met.where(~many)
        done = few if done is None else done.unionByName(few)
        more = met.where(many).select("word", "n", "looks", "own", "head", "tail")
        if more.isEmpty():
            break
        rows = _segments(more, F.col("head"), F.col("tail"))
    subs = F.ceil((F.col("rows") - F.col("owners")) / LOOKING).cast("int")
    sub = F.when(F.col("looks"), F.array(F.pmod(F.xxhash64("word"), subs).cast("int"))).otherwise(F.sequence(F.lit(0), subs - 1))
    return done.withColumn("sub", F.explode(sub)).select("word", "n", "looks", "own", "head", "tail", "key", "sub")


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[k + 1 :] == b[k + (len(a) == len(b)) :]


class Shard:
    """An automaton over segments; `owners` of a segment have one length."""

    def __init__(self, words: list[str], counts: list[int], heads: list[int], tails: list[int]) -> None:
        self.words, self.counts = words, np.array(counts, np.int64)
        self.groups: dict[tuple[int, str, str], list[int]] = {}
        for k, (word, head, tail) in enumerate(zip(words, heads, tails, strict=True)):
            self.groups.setdefault((len(word), word[:head], word[len(word) - tail :]), []).append(k)
        named: dict[str, list[tuple[int, str, str, np.ndarray]]] = {}
        for (length, head, tail), found in self.groups.items():
            named.setdefault(head or tail, []).append((length, head, tail, np.array(found)))
        self.everywhere = named.pop("", [])  # of words of one character
        self.automaton = ahocorasick.Automaton()
        for segment, found in named.items():
            self.automaton.add_word(segment, (len(segment), found))
        if named:
            self.automaton.make_automaton()

    def candidates(self, word: str) -> list[np.ndarray]:
        """Owners of the segments found in `word` at their own place from the beginning or the end, as long as it or one shorter."""
        length = len(word)
        out = [rows for own, _, _, rows in self.everywhere if 0 <= length - own <= 1]
        if len(self.automaton):
            for end, (size, found) in self.automaton.iter(word):
                first, last = end + 1 == size, end + 1 == length
                if first or last:
                    out += [rows for own, head, tail, rows in found if 0 <= length - own <= 1 and (first and word.endswith(tail) if head else last)]
        return out

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words and of owners that are one edit apart."""
        left, right, size = [], [], 0
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k, word in enumerate(words):
            for rows in self.candidates(word):
                left.append(np.full(len(rows), k))
                right.append(rows)
                size += len(rows)
            if size >= CHUNK:
                done.append(self._verified(words, np.concatenate(left), np.concatenate(right)))
                left, right, size = [], [], 0
        if size:
            done.append(self._verified(words, np.concatenate(left), np.concatenate(right)))
        if not done:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def _verified(self, words: list[str], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, place = np.unique(left, return_inverse=True)
        own, back = np.unique(right, return_inverse=True)
        a, b = [words[k] for k in names], [self.words[k] for k in own]
        la, lb = np.array([len(x) for x in a])[place], np.array([len(x) for x in b])[back]
        long = la > WIDE
        ok = np.zeros(len(left), bool)
        for k in np.flatnonzero(long).tolist():
            ok[k] = one_edit(a[place[k]], b[back[k]])
        rest = np.flatnonzero(~long)
        if len(rest):
            width = int(la[rest].max()) + 1
            chars = lambda texts: np.array([t if len(t) < width else "" for t in texts], f"U{width}").view(np.uint32).reshape(len(texts), width)
            x, y, n = chars(a)[place[rest]], chars(b)[back[rest]], lb[rest]
            apart = x != y
            same = la[rest] == n
            # Of a longer word, what follows the first difference is the other's rest from there.
            first = np.argmax(apart, axis=1)
            shifted = (x[:, 1:] != y[:, :-1]) & (np.arange(width - 1) >= first[:, None])
            ok[rest] = np.where(same, apart.sum(axis=1) == 1, ~shifted.any(axis=1))
        return left[ok], right[ok]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's owners come first, then the words that look for them in order, some more than once."""
    kept: tuple[list, list, list, list] = ([], [], [], [])
    shard, last = None, None
    for batch in batches:
        looks = batch.column("looks").to_numpy(zero_copy_only=False)
        begin = int(np.argmax(looks)) if looks.any() else len(looks)
        if begin:
            for into, name in zip(kept, ("word", "n", "head", "tail"), strict=True):
                into.extend(batch.column(name).slice(0, begin).to_pylist())
        if begin == len(looks):
            continue
        shard = shard or Shard(*kept)
        words, counts = [], []
        for word, n in zip(batch.column("word").slice(begin).to_pylist(), batch.column("n").slice(begin).to_pylist(), strict=True):
            if word != last:
                words.append(word)
                counts.append(n)
            last = word
        left, right = shard.near(words)
        # Words of one length look for each other; of two lengths only the longer looks, and both are told.
        a, b = [words[k] for k in left], [shard.words[k] for k in right]
        na, nb = np.array(counts, np.int64)[left], shard.counts[right]
        uneven = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if len(x) != len(y)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a + [b[k] for k in uneven], pa.string()), pa.array(b + [a[k] for k in uneven], pa.string()), pa.array(np.concatenate([nb, na[uneven]]), pa.int64())],
            names=["word", "near", "near_n"],
        )


def near_words(words: DataFrame, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """(word, near, near_n): all pairs of the distinct words (word, n) that are one edit apart, each both ways; a pair may come twice."""
    rows = _placed(words, group)
    owners = rows.where(~F.col("looks")).count()
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-owners // shard))
    return rows.repartition(parts, "key", "sub").sortWithinPartitions("looks", "word").mapInArrow(_scan, "word string, near string, near_n long")


def with_forms(words: DataFrame, near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): the most frequent near word, if it is `ratio` times as frequent at least."""
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its words")
    told = near.repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))
    best = told.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def follow_forms(formed: DataFrame) -> DataFrame:
    """`formed` with `root`: from a word's form to that one's form, to the last. Each round doubles the steps taken; a chain has few, as counts grow by the ratio in each."""
    steps = cut(formed.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        ahead = steps.where("word != root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = cut(moved)
        if moved.where("moved").isEmpty():
            return formed.join(moved.select("word", "root"), "word")
        steps = moved.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = EVERY, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the whole texts."""
    words = cut(count_words(docs, id_col, text_col, min_length, min_count, every))
    formed = cut(with_forms(words, near_words(words), ratio))
    return follow_forms(formed).select("word", "form", "root", "n", "n_near", "form_n")
