import importlib

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "pages", "embeddings", "conversations", "labels"]


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


def test_entry_runs(spark, entry):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert [f.name for f in df.schema.fields] == ["suspicious_id", "source_id", "similarity_score",
                                                  "ground_truth", "source_reference"]


def test_every_oracle_has_a_query(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(importlib.import_module("__spark_entry__")._own_oracle_sql()))
def test_query_matches_oracle_on_smallest_scale(spark, entry, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    exp = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    cols = sorted(got.columns)
    norm = lambda df: sorted(tuple(str(v) for v in row) for row in df[cols].itertuples(index=False))
    assert norm(got) == norm(exp)
