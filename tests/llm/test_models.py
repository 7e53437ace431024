"""Operators 3, 8, 9 and 10: exact parts by plain statements, learned parts by held-out accuracy."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import langid, page_text, q_langid, q_page_text, q_toxicity, quality, toxicity
from palimpsest.llm.common import read
from palimpsest.llm.html_blocks import leaf_blocks
from tests.llm import brute
from tests.llm.conftest import awkward_texts

SF = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ------------------------------------------------------------------ language

def test_forward_sums_all_segmentations():
    vocab = {"a": 1, "b": 2, "ab": 3, "aba": 4, "▁": 5, "▁a": 6}
    theta = np.vstack([np.random.default_rng(0).random((7, 2)), np.zeros((1, 2))])

    def brute_sum(w, col):
        if not w:
            return 1.0
        return sum(theta[vocab.get(w[:j], 0), col] * brute_sum(w[j:], col)
                   for j in range(1, len(w) + 1) if w[:j] in vocab or j == 1)

    for words in (["▁abab", "▁aabc", "▁bbbb"], ["▁" + "ab" * 40, "▁" + "xa" * 40]):
        got = langid.forward(words, vocab, theta)
        if len(words[0]) < 10:
            want = [[math.log(brute_sum(w, c)) for c in (0, 1)] for w in words]
            assert np.allclose(got, want)
        assert np.isfinite(got).all()


def test_forward_looks_pieces_up_together():
    """No lookup per substring of a word: the pieces are read once, and the sums are those of plain lookups."""
    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    rng = random.Random(3)
    pieces = {"▁", "a", "b", "▁ab", "abcde", "bab", "ñ", "\U00010400a"} | {"".join(rng.choices("ab", k=rng.randint(2, 16))) for _ in range(60)}
    vocab = Counted((x, i + 1) for i, x in enumerate(sorted(pieces)))
    theta = np.vstack([np.random.default_rng(1).random((len(vocab) + 1, 3)) / 50, np.zeros((1, 3))])

    def plain(w, col):
        alpha = [1.0]
        for j in range(1, len(w) + 1):
            rows = [(i, vocab[w[i:j]] if w[i:j] in vocab else 0) for i in range(max(0, j - langid.MAX_PIECE), j) if w[i:j] in vocab or j - i == 1]
            alpha.append(sum(alpha[i] * theta[r, col] for i, r in rows))
        return math.log(alpha[-1])

    for m in (1, 5, 16, 17, 33):
        words = ["▁" + "".join(rng.choices("aaabbbcdeñ\U00010400", k=m - 1)) for _ in range(50)]
        assert np.allclose(langid.forward(words, vocab, theta), [[plain(w, c) for c in range(3)] for w in words])
    assert vocab.asked == 0


def test_languages(spark, awkward, empty):
    rows = q_langid.query(spark, SF).join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    model = q_langid.model_for(read(spark, SF, "documents"))
    got = langid.predict(awkward, PIECES, model)
    assert got.count() == len(awkward_texts())
    und = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert und == {5, 6, 7, 19}
    kept = langid.keep_known(awkward, PIECES, model)
    assert kept.columns == awkward.columns and kept.count() == len(awkward_texts()) - 4
    assert langid.predict(empty, PIECES, model).count() == 0
    nothing = langid.fit(empty, PIECES)
    assert langid.keep_known(empty, PIECES, model).count() == 0
    assert nothing[0] == [] and {r.lang_pred for r in langid.predict(awkward, PIECES, nothing).collect()} == {"und"}


def test_language_sample_is_bounded(make, monkeypatch):
    """Null and repeated keys neither crowd the sample nor escape its bound."""
    taken, as_it_is = [], langid.map_batches
    monkeypatch.setattr(langid, "map_batches", lambda df, fn, schema: taken.append(df) or as_it_is(df, fn, schema))
    docs = make([(None, f"null {i}", "en") for i in range(300)] + [(7, f"seven words {i}", "en") for i in range(300)]
                + [(8, "same row", "de")] * 200 + [(1000 + i, f"eigen {i}", "de") for i in range(40)])
    langs, _ = langid.fit(docs, PIECES, sample_rows=20, steps=1)
    rows = taken[0].collect()
    assert langs == ["de", "en"] and all(sum(r.lang == x for r in rows) <= 20 for x in langs)
    assert len({(r.lang, r.t) for r in rows}) == len(rows) and sum(r.lang == "en" for r in rows) == 20
    assert not any(r.t.startswith("null") for r in rows)


# ------------------------------------------------------------------ toxicity

def test_toxicity_learns_subwords(spark, make):
    rng = random.Random(4)
    syllables = ["ba", "ko", "ti", "ren", "lu", "sha", "mor", "vin"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(700):
        toxic = i % 3 == 0
        text = [word() for _ in range(rng.randint(20, 90))]
        if toxic:
            text[rng.randrange(len(text))] = "xqzz" + word()  # endings differ: the rest must be learnt from n-grams
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    table, known = make(docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table, known.where("doc_id < 500"))
    got = {r.doc_id: r.predicted for r in toxicity.score(table, model).collect()}
    late = [y == got[i] for i, y in labels if i >= 500]
    assert sum(late) / len(late) > 0.85


def test_toxicity(spark, awkward, empty):
    rows = q_toxicity.query(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(awkward, model).collect()
    assert len(got) == len(awkward_texts()) and all(r.score is not None for r in got)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(awkward, None).collect()} == {0.0}


def test_toxicity_of_string_keys(spark, make):
    """Keys that are no numbers, repeated and null ones."""
    bad, good = "you are a stupid idiot and a fool ", "the quiet garden has a small pond "
    rows = [(f"d{i}" if i % 9 else "same", (bad if i % 2 else good) * 3) for i in range(120)] + [(None, bad), (None, None)]
    docs = spark.createDataFrame(rows, "name string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(120)] + [("same", 1), (None, 1), ("d1", None)],
                                   "name string, toxic int")
    model = toxicity.fit(docs, labels, key="name")
    got = toxicity.score(docs, model, key="name").collect()
    assert len(got) == len(rows)
    assert {r.predicted for r in got if r.name and r.name != "same" and int(r.name[1:]) % 2} == {1}
    assert {r.predicted for r in got if r.name and r.name != "same" and int(r.name[1:]) % 2 == 0} == {0}


def test_toxicity_sample_keeps_every_document(spark, make, monkeypatch):
    """Long documents and repeated rows do not displace others."""
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") * rng.randint(1, 5) for _ in range(n))
    docs = [(i, prose(24)) for i in range(200)] + [(300, prose(80_000)), (301, prose(80_000))]
    docs += [(i, prose(30)) for i in (302, 303) for _ in range(50)] + [(304, "same words all along here and on again " * 3000)]
    labels = [(i, i % 2) for i, _ in dict(docs).items()]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda *sample: seen.append(sample))
    toxicity.fit(make(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), max_segments=1000)
    toxicity.fit(make(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), max_segments=1)
    (ids, toxic, words), (few, _, _) = seen
    n = Counter(ids.tolist())
    assert set(n) == {i for i, _ in docs} and all(n[i] == 3 for i in range(200))
    # 1000 less three of each short document and 200 of the repeated one, for two long documents and for one
    assert n[300] == 250 and n[301] == 500 and n[302] == n[303] == 200 and n[304] == 1
    assert Counter(few.tolist()) == dict.fromkeys(n, 1) and len(words) == len(ids)


# --------------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/x">x</a><li>y</ul></nav><!-- ad -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div>
<article><h1>A headline &amp; more</h1><p>First <b>bold
 text</b> here, with caf&eacute; &#233; &#x2014; and &lt;tags&gt;.<br>Next line.<p>Second paragraph of the story, long enough to read.
<div class="advert">Buy this</div><p>Third paragraph ends it.</article>
<aside class="sidebar"><p>Related stories</p></aside><section class="comments"><p>Great post, thanks!</p></section>
<form><label>Mail</label><button>Subscribe</button></form><footer>&copy; somebody"""


def test_blocks():
    texts = [b[0] for b in leaf_blocks(PAGE)]
    assert "First bold text here, with café é — and <tags>. Next line." in texts and "T" not in texts
    assert leaf_blocks(None) == leaf_blocks("") == leaf_blocks("<p> <br> </p>") == []
    assert leaf_blocks("<div>" * 30_000 + "deep")[0][0] == "deep"
    leaf_blocks("<b " + "x" * 500_000)
    leaf_blocks("</p></div>" * 1000 + "<" * 1000 + "&#99999999999;&bogus; <![CDATA[x]]> <!bad")


def test_left_out_tags():
    """Heads without an end, formulas, and end tags of what is not open."""
    texts = lambda page: [b[0] for b in leaf_blocks(page)]
    assert texts("<html><head><title>t</title><meta charset=x><p>One.</p><p>Two.</p>") == ["One.", "Two."]
    assert texts("<head><script>a<b</script> <noscript><p>n</p></noscript> Bare text<p>One.") == ["Bare text", "One."]
    assert texts("<head><title>t</title></head><body><p>One.</p></body>") == ["One."]
    assert texts("<p>Area <math><semantics><mrow><mi>a</mi><mo>·</mo><mi>b</mi></mrow>"
                 "<annotation>a \\cdot b</annotation></semantics></math> holds.</p>") == ["Area a·b holds."]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert texts("<p>a<div>b</i></b>c</p>d</div>e") == ["a", "bc", "d", "e"]
    start = time.perf_counter()
    assert len(leaf_blocks("<div>x" * 40_000 + "</i></p>y" * 40_000)) == 80_000
    assert len(leaf_blocks("<p>" + "<i>" * 20_000 + "<div>x</div>" * 20_000)) == 20_000
    assert time.perf_counter() - start < 20


def test_page_text(spark, empty):
    pages = read(spark, SF, "pages")
    model = page_text.fit(pages)
    assert page_text.main_text(PAGE, model) == (
        "A headline & more First bold text here, with café é — and <tags>. Next line. "
        "Second paragraph of the story, long enough to read. Third paragraph ends it.")
    rng = random.Random(77)
    texts = [b[0] for p in pages.limit(5).collect() for b in leaf_blocks(p.html) if "t:article" in b[3]]
    errors = blocks = 0
    for _ in range(60):
        page, labels = page_text.labelled_layout(rng.sample(texts, 5), page_text.PHRASES, rng)
        errors += sum(a != b for a, b in zip(model.label(page), labels))
        blocks += len(labels)
    assert errors / blocks < 0.05
    got = q_page_text.query(spark, SF).collect()
    assert len(got) == 250 and all(r.n_chars == len(r.text) for r in got)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", PAGE), (1, "u", PAGE), (2, None, "<p>" * 9)],
                                "page_id long, url string, html string")
    assert Counter((r.page_id, r.text == "") for r in page_text.extract(odd, model).collect()) == {
        (None, True): 1, (1, True): 1, (1, False): 2, (2, True): 1}
    assert page_text.extract(odd.limit(0), page_text.fit(odd.limit(0))).count() == 0


def test_page_sample_is_bounded_on_null_and_repeated_ids(spark, monkeypatch):
    pages = [(None, f"<article><p>Null page {i} of many.</article>") for i in range(400)]
    pages += [(5, f"<article><p>One id, page {i} here.</article>") for i in range(400)]
    pages += [(6, "<article><p>The very same page.</article>")] * 400
    pages += [(100 + i, f"<article><p>Own page {i} stands.</article>") for i in range(400)]
    table = spark.createDataFrame(pages, "page_id long, html string").repartition(4)
    seen = []
    monkeypatch.setattr(page_text, "train", seen.append)
    monkeypatch.setattr(page_text, "labelled_pages", lambda texts, layouts=4: texts)
    page_text.fit(table)
    page_text.fit(table.repartition(7))
    page_text.fit(table.where("page_id = 6"))
    page_text.fit(table.where("page_id = 5"))
    first, again, same, repeated = seen
    assert len(first) == len(set(first)) == 150 and first == again
    assert all(sum(kind in t for t in first) > 20 for kind in ("Null page", "One id", "Own page"))
    assert len(same) == 1 and len(repeated) == 150


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(5)
    blocks = [("word " * int(n), 0, "p", frozenset({f"c:{n}"})) for n in rng.integers(1, 9, 7)]
    weights = {f: tuple(rng.normal(size=2)) for b in blocks for f in page_text.features(b)}
    model = page_text.Model(weights, rng.normal(size=(2, 2)))

    def score(y):
        return sum(weights[f][s] for b, s in zip(blocks, y) for f in page_text.features(b)) + sum(
            model.change[a, b] for a, b in zip(y, y[1:]))

    best = max(([i >> k & 1 for k in range(7)] for i in range(128)), key=score)
    assert model.label(blocks) == best


# ------------------------------------------------------------------- quality

def test_base_counts(awkward, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.quality_rules(awkward).collect())
    assert got == Counter((k, *brute.quality(t)) for k, t in awkward_texts())
    assert quality.quality_rules(empty).count() == 0


def test_outliers(spark):
    rows = quality.quality_rules(read(spark, SF, "documents")).join(read(spark, SF, "labels"), "doc_id").where(
        ~F.col("base_failed")).collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert sum(r.kept for r in good) / len(good) > 0.99
    assert sum(not r.kept for r in bad) / len(bad) > 0.6


@pytest.mark.parametrize("seed", [1, 2])
def test_distance_is_mahalanobis(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5)) + 3
    rows = spark.createDataFrame([("c", *map(float, r)) for r in x], ["cell", *quality.FLOORS])
    got = quality._with_distance(rows, quality._moments(rows)).toPandas()
    cov = np.cov(x.T, bias=True) + np.diag([f ** 2 for f in quality.FLOORS.values()])
    centred = got[list(quality.FLOORS)].to_numpy() - x.mean(0)
    assert np.allclose(got["d2"], np.einsum("ij,jk,ik->i", centred, np.linalg.inv(cov), centred))


def test_quality_verdicts_of_large_and_small_cells(spark):
    """Distances and verdicts against the concentration steps in numpy: cells of their own, of their language, of all."""
    docs = read(spark, SF, "documents").withColumn("source", F.when(F.col("doc_id") % 50 == 0, "rare").otherwise("main"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 97 == 0, None).otherwise(F.col("lang")))
    rows = quality.quality_rules(docs).toPandas()
    usable = rows[~rows.base_failed]
    rank = lambda d, p: np.sort(d)[math.ceil(p * len(d)) - 1]
    floors = np.diag([f ** 2 for f in quality.FLOORS.values()])

    def estimate(part):
        x = part[list(quality.FLOORS)].to_numpy()
        low, mid, high = (np.array([rank(c, p) for c in x.T]) for p in (0.25, 0.5, 0.75))
        centre, cov = mid, np.diag(((high - low) / 1.349) ** 2)
        far = lambda y: np.einsum("ij,jk,ik->i", y - centre, np.linalg.inv(cov + floors), y - centre)
        for _ in range(quality.STEPS):
            d = far(x)
            near = x[d <= rank(d, quality.SUPPORT) + 1e-12]
            centre, cov = near.mean(0), np.cov(near.T, bias=True)
        scale = max(1.0, rank(far(x), 0.5) / quality.CHI2_MEDIAN)
        return lambda y: far(y) / scale

    used = Counter()
    for (lang, source), cell in rows.groupby(["lang", "source"], dropna=False):
        same_lang = usable[usable.lang.isna()] if lang is None or lang != lang else usable[usable.lang == lang]
        own = same_lang[same_lang.source.isna()] if source is None or source != source else same_lang[same_lang.source == source]
        level, part = next((i, p) for i, p in enumerate([own, same_lang, usable]) if len(p) >= quality.MIN_CELL or i == 2)
        used[level] += 1
        want = estimate(part)(cell[list(quality.FLOORS)].to_numpy())
        assert np.allclose(cell.outlier_d2.astype(float), want, rtol=1e-6, atol=1e-9)
        assert (cell.kept == (~cell.base_failed & (want <= quality.CHI2_CUT))).all()
    assert set(used) == {0, 1, 2}
