"""Learned sentence splitting against a plain statement, and sampling by running totals."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.abbreviations import learned_sentences, scored_words, word_counts
from palimpsest.sources.corpus import sample_cap

OPEN, CLOSE = "([{\"'«“‘„", ")]}\"'»”’,;:"


def core(t):
    return t.lstrip(OPEN).rstrip(CLOSE)


def word(t):
    w = core(t).lower()
    return w[:-1] if w.endswith(".") else w


def plain_words(texts):
    n, stop, lower, inside = Counter(), Counter(), Counter(), Counter()
    for text in texts:
        tokens = (text or "").split()
        for before, t in zip([None, *tokens], tokens):
            w, c = word(t), core(t)
            if re.search(r"[^\W\d_]", w):
                n[w] += 1
                stop[w] += c.endswith(".")
                lower[w] += c[:1].islower()
                inside[w] += c[:1].isupper() and before is not None and not re.search("[.!?:;…][" + re.escape(CLOSE) + r"]*\Z", before)
    p = min(max(sum(stop.values()) / sum(n.values()), 1e-9), 1 - 1e-9)
    out = {}
    for w, a in n.items():
        b, size = stop[w], len(w.replace(".", ""))
        ratio = 2 * (b * math.log(.99) + (a - b) * math.log(.01) - b * math.log(p) - (a - b) * math.log(1 - p))
        score = ratio * math.exp(-size) * (w.count(".") + 1) * size ** (b - a)
        out[w] = (a, b, lower[w], inside[w], pytest.approx(score, rel=1e-9), b > 0 and score >= .3, lower[w] > 0 and inside[w] == 0)
    return out


def plain_sentences(text, words):
    tokens, out, now = (text or "").split(), [], []
    for t, after in zip(tokens, [*tokens[1:], ""]):
        now.append(t)
        c = core(t)
        known = words.get(word(t))
        starts = core(after)[:1].isupper() and words.get(word(after), [False])[-1]
        if c.endswith(("!", "?")) or c.endswith(".") and (not (known and known[-2]) or starts):
            out.append(" ".join(now))
            now = []
    return out + ([" ".join(now)] if now else [])


TEXTS = ["Dr. Smith met Prof. Jones at 5 p.m. on Main St. yesterday. The doctor left. It rained.", "We saw Dr. Brown (see e.g. the notes). \"Stop!\" she said.",
         "Ask Dr. Who? No: ask Prof. Green... The end came. e.g. this.", "", None, "   \n", "one", "She said (e.g. Dr. No). The prof. stayed", "Mr. and Mrs. X. left. Mr. Y. Mrs. Z.",
         "Étienne parla à M. Dupont. Il partit."] * 3


def generated():
    rng = random.Random(2)
    parts = ["Dr.", "dr.", "cat", "Cat", "cat.", "St.", "(e.g.", "the", "The", "end.", "end!", "no?", "x", "p.m.", "5.", "...", "\"Yes.\"", "yes", "a.b.c.", ";"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(60)]


def test_like_the_plain_statement(spark):
    texts = TEXTS + generated()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    words = scored_words(word_counts(docs)).checkpoint()
    want = plain_words(texts)
    assert {r.word: tuple(r)[1:] for r in words.collect()} == want
    assert any(v[5] for v in want.values()) and any(v[6] for v in want.values())
    got = {r.doc_id: r.sentences for r in learned_sentences(docs, words).collect()}
    assert got == {i: plain_sentences(t, want) for i, t in enumerate(texts)}


def test_a_learned_abbreviation_ends_no_sentence(spark):
    docs = spark.createDataFrame([(i, f"We met Dr. Smith{i} there. Then Dr. Brown came in. All was fine. There we sat in fine weather and then went in there.")
                                  for i in range(40)], "doc_id long, text string")
    first = learned_sentences(docs, scored_words(word_counts(docs)).checkpoint()).where("doc_id = 3").first().sentences
    assert first == ["We met Dr. Smith3 there.", "Then Dr. Brown came in.", "All was fine.", "There we sat in fine weather and then went in there."]
    empty = docs.limit(0)
    assert learned_sentences(empty, scored_words(word_counts(empty)).checkpoint()).collect() == []


@pytest.mark.parametrize("n", [0, 1, 7, 50, 51, 120, 199, 200, 1000])
def test_sample_by_running_totals(spark, n):
    rng = random.Random(1)
    rows = [(rng.choice(["p2", "p10", "p1", None]), i % 190) for i in range(200)] + [("p1", None)]
    listing = spark.createDataFrame(rows, "part string, id int").repartition(4)
    hashed = F.coalesce(F.md5(F.concat(F.lit("42|"), F.col("id").cast("string"))), F.lit(""))
    want = listing.orderBy("part", hashed, "id").limit(n)
    got = sample_cap(listing, n)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "rangepartitioning" not in plan and "GlobalLimit" not in plan
