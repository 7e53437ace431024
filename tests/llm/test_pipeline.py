"""The pipeline against its stages' plain statements."""

import importlib
from collections import Counter

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm import packing
from tests.llm import brute


def test_stages_on_awkward_rows(spark, awkward, empty, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "suffix_dedup", "packing"]
    docs = awkward
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        got = stage(spark, docs, None)
        assert got.columns == awkward.columns
        got.write.parquet(str(tmp_path / str(i)))
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = Counter((r.doc_id, r.text) for r in docs.collect())
        if i == 0:
            assert after == Counter((k, t) for k, t in before if any(c.isalpha() for c in t or ""))
        if i == 1:
            assert Counter(k for k, _ in after) == Counter(r[0] for r, n in brute.exact(before).items() if r[3])
        if i == 2:
            stay = brute.first_of_classes(before)
            assert after == Counter((k, t) for k, t in before if (k, t or "") in stay)
        if i == 3:
            assert after == Counter((k, bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore"))
                                    for (k, _), (raw, gone) in zip(before, brute.repeats(before)))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        n = len(whole.encode(r.text, add_special_tokens=False).ids) + 1
        want.update((r.doc_id, x, n) for x in packing.piece_lengths(n, 2048))
    assert Counter((r.doc_id, r.length, r.doc_tokens) for r in pipeline.STAGES[-1][1](spark, docs, None).collect()) == want


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = empty
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, None).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() == 0


def test_registered_queries_match_their_sql(spark):
    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    from palimpsest.llm import registry

    assert len([n for n in entry.queries() if n.startswith("op")]) == 13 and "pipeline" in entry.queries()
    for name, sql in registry.oracle_sql().items():
        got, exp = entry.queries()[name](spark, sf).toPandas(), con.sql(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(exp.columns)
        same = lambda df: sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False))
        assert same(got) == same(exp)
