"""The column stemmer against a plain statement of the algorithm, and the vocabulary job."""

import random

import duckdb
import pytest

from palimpsest import oracle
from palimpsest.operators.prepare import prepare_documents
from palimpsest.operators.stemming import stem_token_arrays, stem_words
from palimpsest.plans.chunks import compare_chunked
from tests.pyref import porter_stem

KNOWN = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration",
    "generalizations": "gener", "oscillators": "oscil", "is": "is",
}


def made_up_words(n, seed=4):
    rng = random.Random(seed)
    ends = ["", "s", "ies", "sses", "ed", "eed", "ing", "y", "yy", "yyyy", "ational", "izer", "ization", "fulness", "icate", "ative", "ement", "ment",
            "ion", "sion", "tion", "ll", "e", "le", "biliti", "ousli", "al", "ance", "ness", "at", "bling", "izing"]
    return sorted({"".join(rng.choice("aeiouyybcdlmnstwxzé") for _ in range(rng.randint(0, 7))) + rng.choice(ends) for _ in range(n)})


def stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    return {r.w: r.stem for r in stem_words(df, "w").collect()}


def test_known_words(spark):
    assert stems(spark, KNOWN) == KNOWN


def test_like_the_plain_statement(spark):
    words = made_up_words(6000)
    assert stems(spark, words) == {w: porter_stem(w) for w in words}


def test_the_oracle_says_the_same():
    words = made_up_words(3000, seed=9)
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS tok", [words])
    got = dict(con.sql("WITH " + oracle.stem_ctes("SELECT tok FROM words") + " SELECT tok, stem FROM stems").fetchall())
    assert got == {w: porter_stem(w) for w in words}


def test_long_null_and_other_words(spark):
    odd = [None, "", "y" * 1001, "ab" * 40_000, "漢字s", "ﬁed", "__"]
    df = spark.createDataFrame([(w,) for w in odd], "w string")
    got = {r.w: r.stem for r in stem_words(df, "w").collect()}
    assert got == {w: None if w is None else porter_stem(w) for w in odd}


@pytest.mark.parametrize("limit", [None, 3, 0])
def test_token_arrays_with_and_without_a_broadcast_head(spark, limit):
    words = made_up_words(300)
    rng = random.Random(1)
    rows = [(i, [rng.choice(words[:4] if rng.random() < 0.7 else words) for _ in range(rng.randint(0, 40))]) for i in range(40)] + [(99, []), (98, None)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(5)
    got = {r.id: r.tokens for r in stem_token_arrays(df, key="id", max_broadcast_rows=limit).collect()}
    assert got == {i: [porter_stem(w) for w in t or []] for i, t in rows}


def test_preparation_and_chunks_stem_by_default(spark):
    docs = spark.createDataFrame([("a", "suspicious", "Running cats. They were relating stories."), ("b", "source", "The cat runs. A story is related.")],
                                 "id string, type string, raw_text string")
    assert {r.processed_text for r in prepare_documents(docs).collect()} == {"run cat thei relat stori", "cat run stori relat"}
    assert {r.processed_text for r in prepare_documents(docs, stem=False).collect()} == {"running cats they relating stories", "cat runs story related"}
    pairs = spark.createDataFrame([("a", "b")], "suspicious_id string, source_id string")
    best = {s: [r.similarity for r in compare_chunked(docs, pairs, chunk_size=1, stem=s)[0].orderBy("suspicious_chunk_idx").collect()] for s in (True, False)}
    assert all(x > 0.3 for x in best[True]) and best[False] == [0.0, 0.0]
