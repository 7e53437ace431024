import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as TX
from palimpsest.functions.ngrams import parse_ngram_range, vectorizer_tokens, word_ngrams
from palimpsest.functions.sentences import explode_chunks, with_chunks
from palimpsest.functions.text import CLITICS, CONTRACTIONS, split_words

from tests import pyref

SAMPLES = [
    "Hello, World! It's 2024 -- the year_of x².",
    "Café naïve façade — déjà vu; ÉTÉ 12h30",
    "école combining mark and Arabic digit ٣ here",
    "tabs\tand\x0bvertical\x0cfeed\r\nline\x1cfile\x85nel nbsp ls　ideo",
    "under_score __init__ a_b 3rd 42 x",
    "",
    "   ",
    "Straße GROSS İstanbul",
    "1.5 and 0.5 are numbers... Really? Yes!",
]


def test_tokens_match_python_semantics(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "id int, t string")
    rows = df.select("id",
                     TX.remove_stopwords(TX.word_tokens("t", html=False)).alias("fast"),
                     TX.remove_stopwords(TX.tokenize(TX.normalize("t", html=False))).alias("slow")
                     ).orderBy("id").collect()
    for r in rows:
        expected = pyref.tokens(SAMPLES[r.id])
        assert list(r.fast) == expected, SAMPLES[r.id]
        assert list(r.slow) == expected, SAMPLES[r.id]


def test_processed_text_joins_with_single_spaces(spark):
    df = spark.createDataFrame([("The  cat,  sat!",)], "t string")
    out = df.select(TX.join_tokens(TX.remove_stopwords(TX.word_tokens("t"))).alias("p")).first().p
    assert out == "cat sat"


@pytest.mark.parametrize("html,expected", [
    ("<p>a</p><p>b</p>", "ab"),
    ("<!DOCTYPE html><html><head><title>T&amp;C</title></head></html>", "t&c"),
    ("<script>var t=\"</p>\";</script>x<style>p{}</style>y", "xy"),
    ("a<!-- hidden -->b", "ab"),
    ("<a href=\"x>y\">link</a> &quot;q&quot; &copy; &middot;", 'link "q" © ·'),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("&amp;lt;", "&lt;"),
])
def test_strip_html(spark, html, expected):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(TX.lower_html_text("h").alias("x")).first().x == expected


def test_is_blank_and_preview(spark):
    df = spark.createDataFrame([(" \t \n",), ("x" * 120,), ("short",)], "t string")
    rows = df.select(TX.is_blank("t").alias("b"), TX.preview("t", "always").alias("a"),
                     TX.preview("t", "if_truncated").alias("i")).collect()
    assert [r.b for r in rows] == [True, False, False]
    assert rows[1].a == "x" * 100 + "..." and rows[1].i == "x" * 100 + "..."
    assert rows[2].a == "short..." and rows[2].i == "short"


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "bb", "cc", "dd"],), ([],), (["xx"],)], "t array<string>")
    rows = df.select(word_ngrams(vectorizer_tokens(F.col("t")), (1, 3)).alias("g")).collect()
    assert sorted(rows[0].g) == sorted(pyref.terms(["a", "bb", "cc", "dd"], 1, 3))
    assert rows[1].g == [] and rows[2].g == ["xx"]
    assert parse_ngram_range("1,3") == (1, 3) and parse_ngram_range("bad") == (1, 2)
    with pytest.raises(ValueError):
        parse_ngram_range((2, 1))


CHUNK_TEXTS = [
    "One. Two! Three? Four.\n\nFive. Six. Seven.",
    "No terminal punctuation at all",
    "...",
    "  ",
    "A. B. C. D. E. F. G. H. I. J. K.",
    "Title line\nFirst sentence. Second one!   Third?\nLast",
    "Decimal 0.5 splits. Ok",
]


@pytest.mark.parametrize("mode,k", [("tfidf", 5), ("tfidf", 2), ("dense", 1), ("dense", 3),
                                    ("tfidf", -1)])
def test_chunking_matches_python(spark, mode, k):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CHUNK_TEXTS)], "id int, text string")
    out = explode_chunks(with_chunks(df, "text", mode, k).drop("text")).collect()
    got = {}
    for r in out:
        got.setdefault(r.id, []).append((r.chunk_idx, r.chunk_text))
    for i, t in enumerate(CHUNK_TEXTS):
        expected = pyref.chunks(t, k, mode) if k > 0 else ([t.replace("!", ".").replace("?", ".")]
                                                           if mode == "tfidf" and t.strip() else
                                                           ([t] if t.strip() else []))
        assert [c for _, c in sorted(got.get(i, []))] == expected, (mode, k, t)


def test_chunk_size_zero_rejected(spark):
    df = spark.createDataFrame([("a. b.",)], "text string")
    with pytest.raises(ValueError):
        with_chunks(df, "text", "tfidf", 0)


def test_pluggable_sentence_fn(spark):
    df = spark.createDataFrame([("a b|c d|e",)], "text string")
    out = with_chunks(df, "text", "tfidf", 2, sentence_fn=lambda c: F.split(c, "[|]")).first().chunks
    assert out == ["a b c d", "e"]


def test_split_words(spark):
    """Pieces, then the splits of a piece, stated one by one."""
    def split(text):
        out = []
        for p in re.findall(r"\w+(?:['.]\w+)*|\.\.\.|--|[^\w\s]", (text or "").lower()):
            halves = next(((a, b) for a, b in CONTRACTIONS if a + b == p), None)
            tail = next((t for t in ["n't", *("'" + c for c in CLITICS)] if p.endswith(t) and p != t), None)
            out += halves or ([p[: -len(tail)], tail] if tail else [p])
        return out

    assert split("I can't, and you cannot -- it's 'fine' ... U.S. won't.") == [
        "i", "ca", "n't", ",", "and", "you", "can", "not", "--", "it", "'s", "'", "fine", "'", "...", "u.s", ".", "wo", "n't", "."]
    texts = [None, "", " \n ", "'s n't 'tis", "it's's cannot's d'ye more'n gonna", "o'clock rock'n'roll they've I'd we'll x'm",
             "a.b.c e.g. 3.14 1,000 -- --- .... ?!", "straße's Émile'd 漢字'll 😀's", "ab" * 40_000 + "n't", "a." * 40_000 + "'s",
             "cannot" * 3, " can not\tcannot\x0bgimme", "'" * 5, "can't've"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.tok for r in df.select("i", split_words(F.lower("text")).alias("tok")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == split(t), t
