"""The number of parts follows the input, so that a task's hash tables do not."""

import re

import pytest

from palimpsest.operators import sizing
from palimpsest.operators.abbreviations import word_counts
from palimpsest.plans import text_queries as TQ
from palimpsest.plans.corpus import detect_reuse


def _rows(n):
    return [(i, f"alpha beta gamma delta {'word' * (i % 3)} alpha beta") for i in range(n)]


def _parts(df):
    return [int(x) for x in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().toString())]


@pytest.mark.parametrize("ngrams", [(1, 2), (3, 3)])
def test_term_counts_in_parts(spark, tmp_path, monkeypatch, ngrams):
    monkeypatch.setattr(sizing, "PART_BYTES", 100)
    spark.createDataFrame(_rows(200), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = TQ.document_term_counts(spark, str(tmp_path), ngrams)
    assert max(_parts(got)) >= 200 * 30 // 100
    want = 200 * (6 + 5 if ngrams == (1, 2) else 4) + sum(1 for i in range(200) if i % 3) * (2 if ngrams == (1, 2) else 1)
    assert sum(r.tf for r in got.collect()) == want


def test_pair_sums_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sizing, "PART_BYTES", 100)
    rows = [(f"s{i}", "source", t) for i, t in _rows(3)] + [(f"d{i}", "suspicious", t) for i, t in _rows(200)]
    corpus = spark.createDataFrame(rows, "id string, type string, raw_text string")
    got = detect_reuse(corpus, prep={"stem": False})
    assert max(_parts(got)) >= 200 * 30 // 100
    assert got.count() == 600


def test_patterns_see_distinct_tokens(spark):
    """The letters of a word are looked at behind the count of its token."""
    plan = word_counts(spark.createDataFrame(_rows(3), "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2
