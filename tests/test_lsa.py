"""The learned embedder against numpy's singular value decomposition."""

import numpy as np
import pytest

from palimpsest.operators.dense import HashingEmbedder
from palimpsest.operators.lsa import fit_lsa, lsa_vectors
from palimpsest.plans.dense import compare_lsa


def weight_rows(w):
    return [(int(u), int(u) % 3, f"t{t}", float(w[u, t])) for u, t in zip(*np.nonzero(w))]


def test_like_numpy_svd(spark):
    rng = np.random.default_rng(4)
    w = (rng.standard_normal((120, 6)) * [30, 20, 12, 8, 5, 3]) @ rng.standard_normal((6, 70)) + 0.01 * rng.standard_normal((120, 70))
    df = spark.createDataFrame(weight_rows(w), "u int, part int, term string, w double").repartition(5)
    model = fit_lsa(df, ["u", "part"], dim=4, oversample=6, power=2)
    u, s, vt = np.linalg.svd(w, full_matrices=False)
    assert np.allclose(model.singular_values, s[:4], rtol=1e-4)
    v = np.zeros((70, 4))
    for r in model.terms.collect():
        v[int(r.term[1:])] = r.v
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)
    assert np.allclose(v @ v.T, vt[:4].T @ vt[:4], atol=1e-3)  # the same subspace
    got = np.zeros((120, 4))
    for r in lsa_vectors(df, model, ["u", "part"]).collect():
        got[r.u] = r.embedding
    assert np.allclose(got @ got.T, (u[:, :4] * s[:4]) @ (u[:, :4] * s[:4]).T, atol=1e-2 * s[0])


def test_low_rank_and_nothing(spark):
    w = np.outer([1.0, 2, 3], [1.0, 1, 0, 2])
    df = spark.createDataFrame(weight_rows(w), "u int, part int, term string, w double")
    model = fit_lsa(df, ["u", "part"], dim=5)
    assert model.singular_values == pytest.approx([np.linalg.norm(w)])
    none = fit_lsa(df.limit(0), ["u", "part"], dim=5)
    assert len(none.singular_values) == 0 and none.terms.count() == 0


def test_chunks_match_by_topic(spark):
    cats, ships = "cats purr and chase mice near warm stoves", "ships carry grain over stormy northern seas"
    docs = spark.createDataFrame([
        ("s1", "source", f"{cats}. {ships}. Old mice sleep near stoves. Grain ships fear stormy seas."),
        ("u1", "suspicious", "Stormy seas and ships with grain. Warm stoves and mice and cats. Qqq zzz."), ("u2", "suspicious", " ")],
        "id string, type string, raw_text string")
    pairs = spark.createDataFrame([("u1", "s1"), ("u2", "s1")], "suspicious_id string, source_id string")
    matches, summary = compare_lsa(docs, pairs, ngram_range=(1, 1), chunk_size=1, dim=2)
    got = {r.suspicious_chunk_idx: (r.source_chunk_idx % 2, round(r.similarity, 1)) for r in matches.collect()}
    assert got[0][0] == 1 and got[1][0] == 0 and got[0][1] > 0.8 and got[2] == (0, 0.0)
    assert {r.suspicious_id: r.compared_chunks for r in summary.collect()} == {"u1": 3, "u2": 0}


def test_truncated_input():
    whole, cut = HashingEmbedder(64), HashingEmbedder(64, max_tokens=2)
    assert (cut.embed(["a b c d"]) == whole.embed(["a b"])).all() and not (cut.embed(["a b c d"]) == whole.embed(["a b c d"])).all()
