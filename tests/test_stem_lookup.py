"""Tokens are looked up and stemmed inside their arrays."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import stemming
from palimpsest.operators.stemming import stem_in_place, stem_token_arrays, stem_words
from tests.pyref import porter_stem
from tests.test_stemming import made_up_words


@pytest.mark.parametrize("limit", [None, 2, 0])
def test_no_token_is_taken_out_of_its_array(spark, limit):
    df = spark.createDataFrame([(i, ["cats", "running", f"walks{'e' * (i % 5)}d"]) for i in range(20)], "id long, tokens array<string>")
    got = stem_token_arrays(df, key="id", max_broadcast_rows=limit)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Exchange" not in plan, plan
    assert {r.id: r.tokens for r in got.collect()} == {i: ["cat", "run", porter_stem(f"walks{'e' * (i % 5)}d")] for i in range(20)}


def test_bytes_bound_what_is_looked_up(spark, monkeypatch):
    words = made_up_words(400)
    df = spark.createDataFrame([(i, words[: 10 * i] + [None]) for i in range(40)], "id int, tokens array<string>")
    monkeypatch.setattr(stemming, "_HEAD_BYTES", 2000)
    got = {r.id: r.tokens for r in stem_token_arrays(df, key="id").collect()}
    assert got == {i: [porter_stem(w) for w in words[: 10 * i]] for i in range(40)}


def test_both_forms_say_the_same(spark):
    words = made_up_words(1500, seed=7) + [None, "", "y" * 50, "CVPs", "漢字s"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = stem_words(df, "w").select("w", "stem", stem_in_place(F.col("w")).alias("inside")).collect()
    assert {(r.w, r.stem, r.inside) for r in got} == {(w, *[None if w is None else porter_stem(w)] * 2) for w in words}


@pytest.mark.parametrize("limit", [None, 0])
def test_rows_of_one_key_and_null_keys(spark, limit):
    rows = [(1, "a", ["cats", "dogs"]), (1, "b", ["running"]), (2, "c", ["cats"]), (None, "d", ["cats"])]
    got = stem_token_arrays(spark.createDataFrame(rows, "id int, x string, tokens array<string>"), key="id", max_broadcast_rows=limit)
    assert got.columns == ["id", "x", "tokens"]
    assert {r.x: r.tokens for r in got.collect()} == {"a": ["cat", "run", "dog"], "b": ["cat", "run", "dog"], "c": ["cat"], "d": []}
