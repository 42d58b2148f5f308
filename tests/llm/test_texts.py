"""Tokenising, fingerprints, languages, pages, toxicity and preferences."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import prose, table
from pyspark.sql import functions as F

from arcflow.llm import chat, fingerprint, html_text, language, pieces, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_are_the_library_s(spark):
    rows = prose(6, 30)
    library = pieces.PieceModel(open(MODEL, "rb").read()).library
    got = pieces.encode_texts(table(spark, rows + rows[:2]), MODEL).collect()
    assert len(got) == len(rows) + 2
    texts = dict(rows)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert (r["ids"], r["decoded"]) == ([*ids, 2], library.decode(ids))
    assert pieces.encode_texts(table(spark, []), MODEL).count() == 0


def test_pieces_of_odd_strings_and_ids():
    model = pieces.PieceModel(open(MODEL, "rb").read())
    rng = random.Random(8)
    letters = " ▁  aébß\n\t<s>😀字한テ\x00thein.!?Ⅷﬁ　­​,;:-_()*#1290"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["thein" * 1500 + " " * 300]
    ids, at = model.encode_column(pa.array(texts), True)
    want = model.library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    assert [model.encode(t) for t in texts[:300]] == want[:300]
    for _ in range(2000):
        some = [rng.choice([rng.randint(0, 31999), rng.randint(3, 258), 259, 0, 1, 2]) for _ in range(rng.randint(0, 10))]
        assert model.decode(some) == model.library.decode(some)


def test_fingerprints(spark):
    rows = prose(7, 40)
    by = sorted(rows)
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_and_follow(table(spark, rows)).collect()}
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint_texts(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    same = {}
    for k, (i, t) in enumerate(by):
        t, n = t or "", by[(k + 1) % len(by)][1] or ""
        edited = fingerprint.edit(t, n)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == alone[i] == same.setdefault(t, alone[i])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if edited == t:
            assert r["near_edited"] == 1 and r["edited_fingerprint"] == r["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 150]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.1


def test_fingerprint_counts_are_of_triplets():
    text = "häufig ab"
    data, rows = np.frombuffer(("xyz" + text).encode(), np.uint8), np.array([0, 3, 3 + len(text.encode())])
    raw = text.encode()
    want = np.zeros(256, int)
    for (b, c), (ta, tb, tc) in zip(fingerprint.TRIPLETS, fingerprint._TABLES, strict=True):
        for k in range(len(raw) - c):
            want[tc[tb[ta[raw[k]] ^ raw[k + b]] ^ raw[k + c]]] += 1
    assert (fingerprint.counts(data, rows)[1] == want).all()


def test_fingerprint_cases(spark):
    assert fingerprint.fingerprint_and_follow(table(spark, [])).count() == 0
    r = fingerprint.fingerprint_and_follow(table(spark, [(4, "abcdefgh")])).collect()[0]
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    two = fingerprint.fingerprint_and_follow(table(spark, [(4, "abcdefgh"), (4, "abcdefgh"), (None, None)])).collect()
    assert len(two) == 3 and {x["n_chars"] for x in two if x["doc_id"] is None} == {0}


def plain_viterbi(scores, switch):
    best = [(s, [k]) for k, s in enumerate(scores[0])]
    for row in scores[1:]:
        best = [max(((v + row[k] - (switch if path[-1] != k else 0), [*path, k]) for v, path in best), key=lambda x: x[0]) for k in range(len(row))]
    return max(best, key=lambda x: x[0])


def test_viterbi():
    rng = np.random.default_rng(2)
    counts = [0, 1, 5, 0, 9, 9, 3, 40]
    bounds = np.concatenate(([0], np.cumsum(counts)))
    scores = rng.normal(0, 3, (bounds[-1], 3)).astype(np.float32)
    labels = language.viterbi(scores, bounds, 2.0)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            own = sum(float(scores[k, labels[k]]) for k in range(a, b)) - 2.0 * int((np.diff(labels[a:b]) != 0).sum())
            assert own == pytest.approx(plain_viterbi(scores[a:b].tolist(), 2.0)[0], abs=1e-3)


def test_languages(spark):
    samples = {"en": "the thing that was there and the other with this is for them", "de": "der und die nicht das ist ein auch auf dem sich werden", "ru": "это слово и другой не был она как что они"}
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(samples[g].split()) for _ in range(30)), g) for k, g in enumerate(["en", "de", "ru"] * 20)]
    model = language.train(table(spark, rows), learn=F.col("doc_id") < 50)
    mixed = "the thing that was there and other " * 3 + "und die nicht das werden ist auch " * 3 + "это слово другой"
    odd = [(100, mixed), (101, None), (102, "123 ..."), (103, "字字"), (104, ""), (105, "❤️ 7")]
    got = {r["doc_id"]: r for r in language.identify(table(spark, rows + odd + odd[:1]), model).dropDuplicates(["doc_id"]).collect()}
    assert all(got[k]["lang"] == g for k, _, g in rows if k >= 50)
    assert [s["lang"] for s in got[100]["spans"]] == ["en", "de", "ru"]
    assert mixed[got[100]["spans"][1]["begin"] :].startswith(("und", "die", "other"))
    assert all(got[k]["lang"] == "und" and got[k]["score"] == 0 for k in (101, 102, 104, 105))
    empty = language.train(table(spark, []))
    assert [r["lang"] for r in language.identify(table(spark, odd), empty).collect()] == ["und"] * 6
    assert language.identify(table(spark, []), model).count() == 0


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    got = language.identify(docs, language.train(docs, learn=kept)).join(docs.withColumnRenamed("lang", "actual"), "doc_id").where(~kept)
    assert got.where("lang = actual").count() >= 0.97 * got.count()


def test_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Menu one</a><li><a>two</a></ul></nav><!-- <p>gone</p> -->
    <div class="ad banner">Buy this now</div><article><h1>Title &amp; more</h1><p><b>First</b> line,\n  wrapped<br>next<p>Second &lt;p&gt; &#x41;
    <ul><li>item <a href="y">link</a><li>other</ul><form><input><label>mail</label></form><div class="comments"><p>A reader writes at length about it.</div></article>
    <aside>Beside</aside><div id="cookie-notice">We use cookies</div><footer>End</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more First line, wrapped next Second <p> A item link other"
    plain = "<div id=header>Name</div><div class='menu'><a href=1>a</a> <a href=2>b</a></div><div><p>" + "A long paragraph of real text, which goes on. " * 3 + "<p>Short.</div><div class=footer>imprint</div>"
    assert html_text.main_text(plain) == ("A long paragraph of real text, which goes on. " * 3).strip() + " Short."
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<script>never closed <p>x", "<nav>x</nav>")] == [""] * 5
    assert len(html_text.main_text("<article>" + "<p>word</p>" * 30000 + "</article>")) == 5 * 30000 - 1


def test_pages_windows_weigh_marks():
    """The story is where the longest windows are; the article mark is a weight."""
    story = [f"Paragraph {k} of the story says what happened, where it happened and to whom." for k in range(4)]
    body = "<div><h1>News</h1>" + "".join(f"<p>{x}</p>" for x in story) + "</div>"
    links = "<div>" + "<p><a href=x>Some other page of this site with a long name</a></p>" * 4 + "</div>"
    card = "<article><h3><a href=y>Another story</a></h3><p>Its short teaser.</p></article>"
    want = " ".join(["News", *story])
    for page in (body, links + body + links, body + card, card * 3 + body + card, links + card + body):
        assert html_text.main_text(page) == want
    assert html_text.main_text(body.replace("<p>Paragraph 2", f"{card}<p>Paragraph 2")) == want
    marked = body.replace("div>", "article>")
    assert html_text.main_text("<p>A line of the site</p>" + marked + card + "<p>Imprint and address</p>") == want
    assert html_text.main_text(marked + links + marked) == f"{want} {want}"


def test_pages_short_and_interrupted():
    assert html_text.main_text("<div><h1>Short news</h1><p>Rain is due.</p></div>") == "Short news Rain is due."
    first = "A paragraph that is long enough to be the story of any page at all."
    adverts = '<div class="ad">Buy this</div>' * 4
    assert html_text.main_text(f"<div><p>{first}</p>{adverts}<p>The end.</p></div>") == f"{first} The end."


def test_pages_dropped_spans():
    cases = {
        '<p>Start <span class="ad">x</span> rest of the sentence.</p>': "Start rest of the sentence.",
        '<p>Start <span class="share">a <span>b</span> c <span class="ad">d</span> e</span>rest <span>of</span> it.</p>': "Start rest of it.",
        '<p>One<span hidden>x</span>word <span class="ad">y<br>z</span>and more.</p>': "Oneword and more.",
        'Bare <span class="social">x</span>text': "Bare text",
        '<p>Start <span class="ad">x <p>Next</span> one.': "Start Next one.",
    }
    for page, want in cases.items():
        assert html_text.main_text(f"<article>{page}</article>") == want
        assert html_text.main_text(page) == want


def test_pages_table(spark):
    rows = [(1, "u", "<article><p>x</p></article>"), (1, "u", "<article><p>x</p></article>"), (2, None, None)]
    got = html_text.extract_text(table(spark, rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["url"] or "", r["text"], r["n_chars"]) for r in got) == [(1, "u", "x", 1)] * 2 + [(2, "", "", 0)]
    assert html_text.extract_text(table(spark, [], "page_id long, url string, html string")).count() == 0


def test_factorization_machine_learns_pairs():
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(sorted({*rng.choice(np.arange(100, 160), 6, replace=False).tolist(), *([7] if a else []), *([9] if b else [])}))
        labels.append(int(a and b) if rng.random() < 0.98 else 1)
    flat, at = np.array(sum(rows, []), np.int32), np.cumsum([0, *map(len, rows)])
    model = toxicity.fit(flat, at, np.array(labels), steps=400)
    probe = [[7], [9], [7, 9], []]
    score = model.scores(np.array(sum(probe, []), np.int32), np.cumsum([0, *map(len, probe)]))
    assert score[2] > 0.8 and max(score[0], score[1], score[3]) < 0.3
    v = model.factors[model.place[[7, 9]]]
    assert v[0] @ v[1] > 1


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = toxicity.train(docs, labels, learn=kept)
    got = toxicity.score_texts(docs, model).join(labels, "doc_id").where(~kept).toPandas()
    order = got.score.rank().values
    ones = got.toxic.values == 1
    assert (order[ones].mean() - order[~ones].mean()) / len(got) + 0.5 > 0.95
    assert got.predicted[~ones].mean() < 0.02 and got.predicted[ones].mean() > 0.7


def test_toxicity_cases(spark):
    docs = table(spark, [(k, "you bad thing" if k % 2 else "kind words here") for k in range(40)] + [(50, None), (51, ""), (0, "kind words here")])
    marks = table(spark, [(k, k % 2) for k in range(40)] + [(3, None), (None, 1), (99, 1), (5, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, model).dropDuplicates(["doc_id"]).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and got[50]["score"] == got[51]["score"]
    none = toxicity.train(docs, table(spark, [], "doc_id long, toxic int"))
    assert toxicity.score_texts(docs, none).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.score_texts(table(spark, []), model).count() == 0


def test_preferences(spark):
    turns = "array<struct<role:string,text:string>>"
    say = lambda *x: [{"role": r, "text": t} for r, t in zip(x[::2], x[1::2], strict=True)]
    rows = [
        (1, say("user", "hi", "assistant", "yo", "user", "é?", "assistant", "A"), say("user", "hi", "assistant", "yo", "user", "other", "assistant", "B")),
        (2, say("user", "q"), say("user", "q", "assistant", "z")),
        (3, None, say("assistant", "x")),
        (4, say(None, None), say("", "")),
    ]
    got = {r["k"]: r for r in chat.format_preferences(spark.createDataFrame(rows, f"k long, chosen {turns}, rejected {turns}"), "k").collect()}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n" and got[1]["prompt_turns"] == 2
    assert got[1]["chosen"] == "<|user|>\né?<|end|>\n<|assistant|>\nA<|end|>\n"
    for side, text in (("chosen", "A<|end|>"), ("rejected", "B<|end|>")):
        assert [got[1][side][m["begin"] : m["end"]] for m in got[1][f"{side}_mask"]] == [text]
    assert (got[2]["chosen"], got[2]["chosen_mask"], got[2]["rejected_turns"]) == ("", [], 1)
    assert (got[3]["prompt"], got[3]["chosen"], got[3]["rejected"]) == ("", "", "<|assistant|>\nx<|end|>\n")
    assert (got[4]["prompt_turns"], got[4]["chosen"], got[4]["rejected"]) == (1, "", "")
    plan = chat.format_preferences(chat.echo_pairs(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")), "conv_id")
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()


def test_echo_pairs(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", None), (2, 0, "user", "only"), (None, 0, "assistant", "x"), (4, 0, "assistant", "first")]
    found = {r["conv_id"]: r for r in chat.echo_pairs(table(spark, rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found.keys() == {1, 4}
    assert [t["text"] for t in found[1]["rejected"]] == ["q", "a", "r", "r"] and len(found[1]["chosen"]) == 4
    assert [t["text"] for t in found[4]["rejected"]] == [""]
    assert chat.echo_pairs(table(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_article_parts_that_look_like_noise():
    """Only attribute names count, only whole class words, and a dive doesn't end a marked article."""
    prose = "This sentence of the story is long enough to count as a line of its own. "
    story = lambda part: f"<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title</h1><p>{prose * 3}</p>{part}<p>{prose * 3}</p></article><footer>Imprint</footer></body>"
    for part in (
        '<p title="hidden costs explained">Kept words here.</p>', '<p data-note="a hidden gem">Kept words here.</p>', '<p title="the class=ad case">Kept words here.</p>', "<p data-x='style=\"display:none\"'>Kept words here.</p>",
        '<section class="social-history"><p>Kept words here.</p></section>', '<div class="share-price"><p>Kept words here.</p></div>', '<section id="related-work"><p>Kept words here.</p></section>', '<div class="alert"><p>Kept words here.</p></div>',
        '<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a><li><a href=4>four</a></ul><p>Kept words here.</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a><li><a href=4>four</a></ul>',
        "<p><a href=1>Kept words here.</a></p><p><a href=2>Another link in prose.</a></p><p><a href=3>And one more link.</a></p>",
    ):
        got = html_text.main_text(story(part))
        assert "Kept words here." in got and "Home" not in got and "Imprint" not in got, part
    closing = story("")[: -len("</article><footer>Imprint</footer></body>")] + "<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a><li><a href=4>four</a></ul><p>The end.</p></article><footer>Imprint</footer></body>"
    assert html_text.main_text(closing).endswith("The end.")
    for part in ('<div class="ad"><p>Gone words here.</p></div>', '<div class="ad-slot top"><p>Gone words here.</p></div>', '<div class="share-buttons">Gone words here.</div>', '<p hidden>Gone words here.</p>', '<section id="comments"><p>Gone words here.</p></section>', '<div class="cookie-notice">Gone words here.</div>', "<aside>Gone words here.</aside>", '<p style="display: none">Gone words here.</p>'):
        assert "Gone" not in html_text.main_text(story(part)), part


def test_attributes_in_linear_time():
    import time

    for text in ('<p ' + 'a="' * 200_000 + ">x", "<p " + "a " * 300_000 + ">x", "<p " + "a" + " " * 500_000 + ">x", "<p class='" + "ad " * 200_000 + "'>x</p>"):
        began = time.perf_counter()
        html_text.main_text(text)
        assert time.perf_counter() - began < 5, text[:20]


def neutral_pair(n, seed, others=5000):
    """Rows whose label says whether both or none of two terms is there; each says nothing by itself, nor does any of 5,000 others."""
    rng = np.random.default_rng(seed)
    pair = rng.random((n, 2)) < 0.5
    labels = (pair[:, 0] == pair[:, 1]).astype(int)
    rows = [np.unique(np.concatenate([np.array([7, 11])[p], 100 + rng.integers(0, others, 60)])) for p in pair]
    return np.concatenate(rows).astype(np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), labels


def test_a_pair_of_neutral_terms_is_learned():
    model = toxicity.fit(*neutral_pair(3000, 1))
    assert model.place[7] >= 0 and model.place[11] >= 0
    found, offsets, labels = neutral_pair(2000, 2)
    score = model.scores(found, offsets)
    order = np.argsort(np.argsort(score)) + 1
    toxic = labels == 1
    auc = (order[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.9


def test_pairs_of_rare_events_and_of_chance():
    """A pair with 8 % each of which both mean toxic; without it no pair is told."""
    rng = np.random.default_rng(3)
    n = 16_000
    a, b = rng.random(n) < 0.08, rng.random(n) < 0.08
    rows = [np.unique(np.concatenate([rng.integers(100, 2100, 40), [7] * int(x), [11] * int(y)])).astype(np.int32) for x, y in zip(a, b, strict=True)]
    found, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    every = np.bincount(found, minlength=1 << toxicity.BITS)
    of = toxicity.frequent_terms(every, n)
    for both, want in ((a & b, {7, 11}), (rng.random(n) < 0.01, set())):
        labels = (both | (rng.random(n) < 0.05)).astype(float)
        assert set(toxicity.telling_pairs(found, offsets, labels - labels.mean(), of).tolist()) == want
