"""Pair comparison from per-document vectors, against the plain calculation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import MINIMAL_STOPWORDS
from palimpsest.operators import pairvectors
from palimpsest.operators.pairvectors import document_vectors, pair_best_matches, with_source
from palimpsest.plans.chunks import compare_chunked
from tests import pyref

assert set(MINIMAL_STOPWORDS) == pyref.STOP


def made_up_documents(n, seed, words=30, sentences=12):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)] + ["x", "the", "of"]
    return {f"d{i}": ". ".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, sentences))) for i in range(n)}


def plain(a, b):
    """``(suspicious chunk, source chunk, similarity)`` by the definitions."""
    sides = []
    for text in (a, b):
        chunks = [pyref.tokens(c) for c in pyref.chunks(text, 2)]
        sides.append([(i, pyref.terms(c)) for i, c in enumerate(chunks) if c])
    sus, src = sides
    fit = [t for _, t in sus + src]
    if not sus or not src:
        return []
    w = pyref.tfidf(fit, fit)
    out = []
    for (i, _), u in zip(sus, w):
        sims = [round(pyref.cosine(u, v), 10) for v in w[len(sus):]]
        best = max(range(len(src)), key=lambda j: (sims[j], -j))
        out.append((i, src[best][0], pytest.approx(sims[best])))
    return out


@pytest.mark.parametrize("cells,pairs_per_group", [(1 << 22, 64), (7, 2)])
def test_like_the_plain_calculation(spark, monkeypatch, cells, pairs_per_group):
    monkeypatch.setattr(pairvectors, "CELLS", cells)
    texts = made_up_documents(14, 3) | {"blank": "  ", "one": "x x x. the"}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "id string, raw_text string")
    ids = sorted(texts)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i % 3::2]]
    frame = spark.createDataFrame(pairs, "suspicious_id string, source_id string")
    matches, summary = compare_chunked(docs, frame, chunk_size=2, stem=False)
    got = {}
    for r in matches.collect():
        got.setdefault((r.suspicious_id, r.source_id), []).append((r.suspicious_chunk_idx, r.source_chunk_idx, r.similarity))
    want = {(a, b): plain(texts[a], texts[b]) for a, b in pairs}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert {(r.suspicious_id, r.source_id) for r in summary.collect()} == set(pairs)


def test_best_of_pair_in_strips(monkeypatch):
    rng = np.random.default_rng(1)

    def vector(n, terms):
        x = rng.integers(0, 3, size=(n, terms)) * (rng.random((n, terms)) < 0.3)
        chunk, at = np.nonzero(x)
        order = np.argsort(at, kind="stable")
        return x, {"chunks": np.arange(n), "terms": np.arange(terms) * 7, "df": (x > 0).sum(0), "at": at[order], "chunk": chunk[order], "tf": x[chunk, at][order]}

    (x, a), (y, b) = vector(40, 25), vector(30, 25)
    idf = np.log((1 + 70) / (1 + a["df"] + b["df"])) + 1
    unit = lambda m: m * idf / np.maximum(np.linalg.norm(m * idf, axis=1, keepdims=True), 1e-300)
    sims = unit(x) @ unit(y).T
    for cells in (1 << 22, 100, 1):
        monkeypatch.setattr(pairvectors, "CELLS", cells)
        best, score = pairvectors.best_of_pair(a, b)
        assert np.allclose(score, sims.max(axis=1)) and best.tolist() == np.argmax(np.round(sims, 10), axis=1).tolist()


def test_a_popular_source_is_dealt_over_tasks(spark):
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        pairs = spark.createDataFrame([(f"u{i}", "hot") for i in range(3000)] + [("u1", "cold")], "suspicious_id string, source_id string")
        sources = spark.createDataFrame([("hot", 1), ("cold", 2)], "source_id string, v int")
        joined = with_source(pairs, sources, 200)
        assert sorted(joined.collect()) == sorted(pairs.join(sources, "source_id").select(*joined.columns).collect())
        # a shuffle join, as for vectors too large to broadcast
        spread = with_source(pairs, sources, 200).groupBy("source_id", F.spark_partition_id().alias("task")).count()
        sizes = [r["count"] for r in spread.where("source_id = 'hot'").collect()]
        assert len(sizes) > 3 and max(sizes) < 1500 and sum(sizes) == 3000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_token_reaches_the_pairs(spark):
    texts = made_up_documents(4, 5)
    units = spark.createDataFrame([(k, 0, pyref.terms(pyref.tokens(t))) for k, t in texts.items()], "id string, chunk_idx int, terms array<string>")
    vectors = document_vectors(units).checkpoint()
    pairs = spark.createDataFrame([("d0", "d1"), ("d2", "d3")], "suspicious_id string, source_id string")
    best = pair_best_matches(vectors, pairs)
    plan = best._jdf.queryExecution().toString()
    assert "array<string>" not in plan and "tokens" not in plan and "Generate explode(terms" not in plan
    assert [f.name for f in best.schema] == ["suspicious_id", "source_id", "suspicious_chunk_idx", "source_chunk_idx", "similarity"]
