"""Stop words are looked up in a set."""

from pyspark.sql import functions as F

from palimpsest.functions.text import MINIMAL_STOPWORDS, remove_stopwords


def test_stop_words_are_a_set(spark):
    df = spark.createDataFrame([(["the", "cat", None, "is", "an", "animal"],), ([],), (None,)], "t array<string>")
    got = df.select(remove_stopwords("t").alias("t"))
    assert "array_contains" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.t for r in got.collect()] == [["cat", "animal"], [], None]
    assert len(MINIMAL_STOPWORDS) == 27 and df.select(remove_stopwords("t", ()).alias("t")).first().t == ["the", "cat", "is", "an", "animal"]
