"""Near-duplicates, windows, contamination and language models against plain versions."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import WORD, lower, prose, table
from pyspark.sql import functions as F

from arcflow.llm import components, decontaminate, exchange, katz, neardup, substrings


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def plain_components(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    edges = [(k, k + 1) for k in range(20, 45)] + [(7, 3), (3, 7), (9, 9), (100, 50), (50, 60)] + [(1, k) for k in range(200, 260)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_components([e for e in edges if e[0] != e[1]], {x for e in edges for x in e} - {9})
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [128, 4])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = prose(1, 60)
    base = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21 w22 w23 w24 w25 w26 w27 w28 w29 w30 w31 w32 w33 w34 w35 w36 w37 w38 w39 w40".split()
    rows += [(1000 + k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(0, 40, 2)]
    sets = plain_sets(rows)
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = plain_components(links, ids)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(table(spark, rows + rows[:3])).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_near_duplicates_cases(spark):
    got = neardup.near_duplicates(table(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "z z z z z y"), (9, "z z z z z y"), (2, None), (1, "")])).collect()
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by == {(None, 2): None, (5, 2): 5, (9, 2): 5, (2, 0): 2, (1, 0): 1}
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_of_ids_with_several_texts(spark):
    """Each signature goes with its own text, whichever text of the id comes first."""
    rows = []
    for k in range(30):
        base = [f"d{k}w{x}" for x in range(60)]
        texts = [" ".join(base), *(" ".join(f"d{k}other{j}w{x}" for x in range(50)) for j in range(2))]
        rows += [(k, t) for t in (texts if k % 2 else texts[::-1])]
        rows.append((100 + k, " ".join([*base, "tail"])))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i % 100 for i, _ in rows}


def test_substrings(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", 500)
    rows = prose(2, 60)
    seen, want = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert sum(x[1] for x in want.values()) > 100
    got = substrings.remove_repeats(table(spark, rows + rows[1:3])).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]]


def test_substrings_with_few_cells_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CELLS_PER_BYTE", 1e-9)
    rows = prose(3, 30)
    few = {r["doc_id"]: r["kept_text"] for r in substrings.remove_repeats(table(spark, rows), depth=1).collect()}
    monkeypatch.undo()
    assert few == {r["doc_id"]: r["kept_text"] for r in substrings.remove_repeats(table(spark, rows)).collect()}


def test_substrings_cases(spark):
    text = " ".join(f"w{k}" for k in range(25))
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(table(spark, [(4, text), (None, text), (-3, text)])).collect()}
    assert got == {None: 0, -3: 25, 4: 25}
    assert substrings.remove_repeats(table(spark, [])).count() == 0


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("limit", [decontaminate.SHARD_BYTES, 150])
def test_contamination(spark, limit):
    rows = prose(4, 40)
    words = rows[9][1].split()
    items = [(1, " ".join(words[2:16])), (2, "One!"), (11, rows[2][1]), (3, None), (4, "..."), (None, "a b c"), (1, " ".join(words[2:16])), (5, "A, b (c)")]
    found = {}
    for i, t in items:
        w = ITEM.findall(lower(t))
        n = min(10, len(w))
        if i is not None and w:
            for k in range(len(w) - n + 1):
                found.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    got = decontaminate.find_contamination(table(spark, rows + rows[:1]), table(spark, items, "item_id long, text string"), shard_bytes=limit).collect()
    assert len(got) == len(rows) + 1
    texts = dict(rows)
    for r in got:
        w, hit, ids = ITEM.findall(lower(texts[r["doc_id"]])), set(), set()
        for key, names in found.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    ids |= names
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(w), len(hit), sorted(ids))
        inside = [x for s in r["spans"] for x in ITEM.findall(lower(texts[r["doc_id"]][s["begin"] : s["end"]]))]
        assert len(inside) == len(hit)
    assert any(r["n_hit"] for r in got)
    assert decontaminate.find_contamination(table(spark, []), table(spark, items, "item_id long, text string")).count() == 0
    assert decontaminate.find_contamination(table(spark, rows), table(spark, [], "item_id long, text string")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("hot", [0, 4, 10_000])
def test_language_model(spark, hot, monkeypatch):
    """Whether no word, some words or all words are frequent, scores are the same."""
    monkeypatch.setattr(katz, "HOT", hot)
    rows = prose(5, 60)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    texts = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    one, two = Counter(), Counter()
    for i, w in texts.items():
        if not held[i]:
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    times = Counter(two.values())
    d = katz.discounts(np.array([times[k] for k in range(katz.TOP + 2)]))
    after = defaultdict(list)
    for (a, b), c in two.items():
        after[a].append((b, c))
    low = lambda w: (one[w] + 1) / (n + v + 1)
    own = lambda c: c * (d[c] if c <= katz.TOP else 1)
    back = {}
    for a, pairs in after.items():
        total = one[a] + all(c > katz.TOP for _, c in pairs)
        back[a] = total, (1 - sum(own(c) for _, c in pairs) / total) / (1 - sum(low(b) for b, _ in pairs))
        whole = sum(own(two[a, b]) / total if two[a, b] else back[a][1] * low(b) for b in one) + back[a][1] / (n + v + 1)
        assert whole == pytest.approx(1)
    got = katz.score_documents(table(spark, rows), learn=F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()
    assert len(got) == len(rows)
    for r in got:
        w = texts[r["doc_id"]]
        score = math.log10(low(w[0]))
        for a, b in zip(w, w[1:], strict=False):
            total, alpha = back.get(a, (1, 1))
            score += math.log10(own(two[a, b]) / total if two[a, b] else alpha * low(b))
        assert (r["learned"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not held[r["doc_id"]], len(w), sum(one[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(low(x)) for x in w))
        assert r["score"] == pytest.approx(score)


def test_language_model_cases(spark):
    assert katz.score_documents(table(spark, [])).count() == 0
    r = katz.score_documents(table(spark, [(1, "a b"), (None, None)]), learn=F.lit(None).cast("boolean")).orderBy("doc_id").collect()
    assert [(x["doc_id"], x["n_tokens"], x["n_known"], x["score"]) for x in r] == [(None, 1, 0, 0.0), (1, 3, 0, 0.0)]
    for seen in ([0] * 7, [0, 5, 0, 1, 0, 0, 0], [0, 9, 4, 2, 1, 1, 1], [0, 100, 1, 50, 1, 60, 1]):
        d = katz.discounts(np.array(seen))[1:]
        assert ((d > 0) & (d < 1)).all()


def test_language_model_part_in_little_memory(monkeypatch):
    """What a part takes at once is bounded by its tokens and pairs, and pieces don't change what it holds."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(katz, "PIECE", 1 << 14, raising=False)
    monkeypatch.setattr(katz, "SLICE_BYTES", 1 << 17)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 1000) % 3000).encode() for _ in range(400)]
    data = exchange.pack(np.arange(400), np.arange(400), np.arange(400, dtype=np.uint8) % 2, np.array([len(x) for x in texts]), b"".join(texts))
    tracemalloc.start()
    t = katz.read_part([data])
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = len(t.token)
    assert n == 401 * 1000 - 1000 + 400 and used < 40 * n
    assert (t.words[t.token[t.bounds[1:] - 1]] == katz.END).all() and (np.diff(t.words.astype(object)) > 0).all()
    inner = np.flatnonzero(t.pair >= 0)
    assert len(inner) == n - 400 and (t.pair[t.bounds[:-1]] == -1).all()
    key = t.token.astype(np.int64)[inner] * len(t.words) + t.token[inner - 1]
    assert (t.pairs[t.pair[inner]] == key).all() and (t.pairs == np.unique(key)).all()
