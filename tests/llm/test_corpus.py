"""Spelling variants, filter audits and mixtures against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from cases import WORD, prose, table
from pyspark.sql import functions as F

from arcflow.llm import audit, mixing, spelling


def plain_words(rows, least=6, count=5):
    out = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= count}


def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or any(a[:k] + a[k + 1 :] == b or b[:k] + b[k + 1 :] == a for k in range(max(len(a), len(b)))) and len(a) != len(b)


def plain_variants(words):
    near = {a: [b for b in words if plain_near(a, b)] for a in words}
    form = {}
    for a in words:
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best and words[best] >= 5 * words[a] else None
    out = {}
    for a in words:
        root = a
        while form[root]:
            root = form[root]
        out[a] = (form[a], root, words[a], len(near[a]), words.get(form[a]))
    return out


def got_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def misspelt(seed, n):
    """Texts of words with errors, a hot beginning, accents and words of one to 3,000 letters."""
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["common" + "".join(rng.choice("ab") for _ in range(4)) for _ in range(30)] + ["x" * 3000, "x" * 2999 + "y", "ß" * 7]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = names[int(len(names) * rng.random() ** 2)]
            if rng.random() < 0.15:
                at = rng.choice([1, 4])
                w = w[:at] + rng.choice(["", "a", "é"]) + w[at + rng.randint(0, 1) :]
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((k, rng.choice([" ", "-", "7 "]).join(words)))
    return rows + [(None, "nameless nameless Nameless NAMELESS nameless nameles"), (None, None), (5, ""), (6, "12 34"), rows[0], rows[0]]


@pytest.mark.parametrize("limits", [{}, {"GROUP": 3, "LOOKING": 4, "WIDE": 8, "CHUNK": 20}])
def test_spelling_variants(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(spelling, name, value)
    rows = misspelt(1, 250)
    words = plain_words(rows)
    want = plain_variants(words)
    assert sum(w[0] is not None for w in want.values()) > 10 and len(words) > 70
    docs = table(spark, rows)
    counted = spelling.count_words(docs)
    assert {r["word"]: r["n"] for r in counted.collect()} == words
    near = spelling.near_words(counted, group=spelling.GROUP)
    assert {(r["word"], r["near"]) for r in near.collect()} == {(a, b) for a in words for b in words if plain_near(a, b)}
    assert got_variants(spelling.spelling_variants(docs)) == want


def test_spelling_of_tiny_words_ties_and_chains(spark):
    words = {"a": 700, "b": 900, "ab": 30, "abc": 6, "q": 5, "xyz": 9, "xyy": 45, "xya": 45, "": 0}
    words.pop("")
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = got_variants(spelling.follow_forms(spelling.with_forms(frame, spelling.near_words(frame))))
    assert got == plain_variants(words)
    assert got["abc"][:2] == ("ab", "b") and got["xyz"][0] == "xya"
    with pytest.raises(ValueError):
        spelling.with_forms(frame, frame, ratio=1)
    assert spelling.spelling_variants(table(spark, [])).count() == 0


def test_a_hot_segment_costs_rows_in_proportion(spark):
    """Words that share one half are told apart by longer segments, not by pairs."""
    sizes = []
    for n in (1000, 2000):
        rng = random.Random(n)
        words = {"prefixprefix" + "".join(rng.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(n)}
        frame = spark.createDataFrame([(w, 9) for w in words], "word string, n long")
        sizes.append(spelling._placed(frame, 32).count() / len(words))
        assert spelling.near_words(frame, 32).count() == 0
    assert sizes[1] < 12 and sizes[1] < 1.5 * sizes[0] + 1


def plain_audit(rows, labels):
    first, marks = {}, defaultdict(lambda: (0, 0))
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            marks[i] = (max(marks[i][0], q or 0), max(marks[i][1], x or 0))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        docs.append((s or "", {k for k, v in fails.items() if v}, *(marks[i] if i is not None else (0, 0))))
    out, removals = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                early = [d for d in docs if d[0] == part and f in d[1] and d not in left and d[1] & set(order[: step - 1])]
                left = [d for d in left if f not in d[1]]
                only = sum(d[0] == part and d[1] == {f} for d in docs)
                removals[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(early), only, sum(d[2] == 1 for d in gone), sum(d[3] == 1 for d in gone)]
    return {k: (*v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["web", "books", "", None])) for i, t in prose(5, 25, words=260, vocabulary=150)]
    rows += [(1000 + k, t, s) for k, (_, t, s) in enumerate(rows[::4])] + [(None, rows[0][1], "web"), (None, "no id & no label", None), (7, "twice", "web"), (7, "twice", "web"), (7, "another text", "web")]
    rows += [(2000, "SHOUTING " * 300, "web"), (2001, "100% $ sure", "books"), (2002, " ".join(f"w{k}" for k in range(200)), "web"), (2003, " ".join(f"w{k}" for k in range(199)), "web"), (2004, "a b " * 100, "web")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i, _, _ in rows if i is not None and rng.random() < 0.7] + [(None, 1, 1), (2000, None, None), (999_999, 1, 1)]
    docs = table(spark, rows, "doc_id long, text string, source string").drop("part")
    got = audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(rows, labels)
    assert len(got) == len(want)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    for r in got:
        assert tuple(r[n] for n in names) == want[r["part"], r["filter_order"], r["step"]], r
    empty = audit.audit_filters(table(spark, [], "doc_id long, text string, source string").drop("part"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0


def plain_targets(sizes):
    """Water-filling as the rule says it: whoever is above stops, the rest is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        left, among = total - sum(2 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        share = {s: 2 * sizes[s] if s in full else left * weight[s] / among for s in order}
        above = {s for s in order if s not in full and share[s] > 2 * sizes[s]}
        if not above:
            return share
        full |= above


def plain_mix(rows):
    rows = [(i, len(WORD.findall(t or "")), s) for i, t, s in rows]
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    share, turns = plain_targets(sizes), []
    for source in sizes:
        at = 0
        queue = sorted((c, int(hashlib.md5(":".join(str(x) for x in (42, c, i) if x is not None).encode()).hexdigest()[:15], 16), i is not None, i or 0, n, k) for k, (i, n, s) in enumerate(rows) if s == source for c in range(2))
        for c, key, named, i, n, k in queue:
            words = max(0, min(n, -int(-share[source] // 1) - at))
            if words:
                turns.append((min(1.0, (at + words) / share[source]), "" if source is None else "=" + source, c, key, named, i, n, k, words))
            at += n
    at, taken = 0, Counter()
    for turn in sorted(turns):
        taken[turn[-2]] += max(0, min(turn[-1], int(1.5 * sum(sizes.values())) - at))
        at += turn[-1]
    return [(i, n, sizes[s], share[s], taken[k]) for k, (i, n, s) in enumerate(rows)]


@pytest.mark.parametrize("sources", [["a", "b", None, "ä", "", "Z"], ["hot"] * 8 + ["rare"], ["one"], [f"s{k}" for k in range(40)]])
def test_mixing(spark, sources):
    rng = random.Random(len(sources))
    rows = [(i, t, rng.choice(sources)) for i, t in prose(6, 60, words=90)]
    rows += [(None, "a row without id", sources[0]), (None, "another one", sources[0]), rows[3], rows[3], (3000, None, "silent"), (3001, " \n", "silent")]
    want = plain_mix(rows)
    docs = table(spark, rows, "doc_id long, text string, source string").drop("size")
    mixed = mixing.mix(docs).withColumn("mark", F.lit(1))
    got = [tuple(r) for r in mixing.taken_words(mixed).collect()]
    order = lambda x: sorted(x, key=lambda r: (r[0] is not None, *((r[0] or 0), *r[1:])))
    assert len(got) == len(rows)
    for a, b in zip(order(got), order(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-12) and a[4] == b[4]
    by = defaultdict(int)
    for (_, _, s), r in zip(rows, want, strict=True):
        assert 0 <= r[4] <= 2 * r[1]
        by[s] += r[4]
    share = plain_targets({s: sum(r[1] for (_, _, x), r in zip(rows, want, strict=True) if x == s) for _, _, s in rows})
    assert all(abs(by[s] - share[s]) <= len(by) for s in by)
    assert sum(by.values()) == int(1.5 * sum(r[1] for r in want))
    # The mix's own order: no gap, and by virtual time.
    line = sorted((r["position"], r["words"], r["finish"]) for r in mixed.where("words > 0").collect())
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(line, line[1:], strict=False))


def test_mixing_nothing(spark):
    for rows in ([], [(1, None, "a"), (2, "", None)]):
        got = mixing.taken_words(mixing.mix(table(spark, rows, "doc_id long, text string, source string"))).collect()
        assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0.0, 0) for i, _, _ in rows]
    with pytest.raises(ValueError):
        mixing.targets(spark.createDataFrame([], "source string, name string, size long"), budget=3)
