
import numpy as np
import pytest

from palimpsest.operators.dense import dense_top1
from palimpsest.plans.chunks import compare_chunked
from palimpsest.plans.dense import compare_dense

from tests import pyref

SOURCE = ("River boats carried grain to the northern towns every spring. "
          "Merchants counted sacks by lantern light. The harbour master kept a ledger of names. "
          "Children watched the cranes swing over the docks. Rain came early that year. "
          "Millers argued about the price of flour. A new bridge was planned near the mill. "
          "Engineers drew careful plans on long paper rolls. The council met twice to vote. "
          "Nobody expected the flood that followed.")
VERBATIM = ("Merchants counted sacks by lantern light. The harbour master kept a ledger of names. "
            "Completely different words appear here now. Orchards bloom beside quiet lanes. "
            "Engineers drew careful plans on long paper rolls. The council met twice to vote! "
            "Foxes wander through frosty fields? 1234 5678.")
PARAPHRASE = ("Traders tallied bags under lamp glow. The port chief recorded names in a book. "
              "Kids observed cranes moving above the quay.")


def _expected_pair(src_text, sus_text, k=5, t=0.3):
    sc, uc = pyref.chunks(src_text, k), pyref.chunks(sus_text, k)
    st = [(i, pyref.terms(pyref.tokens(c))) for i, c in enumerate(sc) if pyref.tokens(c)]
    ut = [(i, pyref.terms(pyref.tokens(c))) for i, c in enumerate(uc) if pyref.tokens(c)]
    fit = [x for _, x in st] + [x for _, x in ut]
    ws = pyref.tfidf(fit, [x for _, x in st])
    wu = pyref.tfidf(fit, [x for _, x in ut])
    rows = []
    for (ui, _), a in zip(ut, wu):
        sims = [round(pyref.cosine(a, b), 10) for b in ws]
        best = max(range(len(sims)), key=lambda j: (sims[j], -j))
        rows.append((ui, st[best][0], pyref.cosine(a, ws[best])))
    return rows


@pytest.mark.parametrize("k", [5, 1, 2])
def test_compare_chunked_matches_python(spark, k):
    docs = spark.createDataFrame([("src", SOURCE), ("v", VERBATIM), ("p", PARAPHRASE), ("e", "   ")],
                                 "id string, raw_text string")
    pairs = spark.createDataFrame([("v", "src"), ("p", "src"), ("e", "src")],
                                  "suspicious_id string, source_id string")
    matches, summary = compare_chunked(docs, pairs, chunk_size=k, stem=False)
    got = {}
    for r in matches.collect():
        got.setdefault(r.suspicious_id, []).append((r.suspicious_chunk_idx, r.source_chunk_idx, r.similarity))
    for sus_id, text in (("v", VERBATIM), ("p", PARAPHRASE)):
        exp = _expected_pair(SOURCE, text, k)
        rows = sorted(got[sus_id])
        assert [(a, b) for a, b, _ in rows] == [(a, b) for a, b, _ in exp]
        assert [c for _, _, c in rows] == pytest.approx([c for _, _, c in exp], abs=1e-9)
    summ = {r.suspicious_id: r for r in summary.collect()}
    assert summ["e"].compared_chunks == 0 and summ["e"].overall_similarity == 0.0
    exp_v = _expected_pair(SOURCE, VERBATIM, k)
    assert summ["v"].overall_similarity == pytest.approx(sum(c for *_, c in exp_v) / len(exp_v))
    assert summ["v"].flagged_chunks == sum(c >= 0.3 for *_, c in exp_v)


def test_dense_top1_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in ("a", "b"):
        for i in range(37):
            rows.append((g, i, [float(x) for x in rng.normal(size=5)]))
    rows.append(("a", 99, [0.0] * 5))
    rows.append(("a", 100, list(rows[3][2])))  # duplicate of a/3 -> tie, lower id wins
    df = spark.createDataFrame(rows, "g string, i long, v array<double>")
    got = {(r.g, r.i): (r.j, r.similarity) for r in
           dense_top1(df, df.withColumnRenamed("i", "j"), group=["g"], sus_idx="i", src_idx="j",
                      vec="v", block_rows=8, exclude_self=True).collect()}
    for g in ("a", "b"):
        members = [(i, np.array(v)) for gg, i, v in rows if gg == g]
        for i, a in members:
            best = None
            for j, b in sorted(members, key=lambda x: x[0]):
                if i == j:
                    continue
                d = np.linalg.norm(a) * np.linalg.norm(b)
                s = float(a @ b / d) if d > 0 else 0.0
                if best is None or round(s, 10) > round(best[1], 10):
                    best = (j, s)
            assert got[(g, i)][0] == best[0], (g, i)
            assert got[(g, i)][1] == pytest.approx(best[1], abs=1e-9)


def test_compare_dense_runs_and_flags_copies(spark):
    docs = spark.createDataFrame([("src", SOURCE), ("v", VERBATIM)], "id string, raw_text string")
    pairs = spark.createDataFrame([("v", "src")], "suspicious_id string, source_id string")
    matches, summary = compare_dense(docs, pairs)
    rows = matches.orderBy("suspicious_chunk_idx").collect()
    assert rows[0].similarity == pytest.approx(1.0) and rows[0].is_flagged
    assert summary.first().compared_chunks == len(rows)


def _nearest_by_numpy(x, labels):
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sims = np.round(unit @ unit.T, 10)
    sims[np.arange(len(x)), np.arange(len(x))] = -np.inf
    sims[labels[:, None] != labels[None, :]] = -np.inf
    best = np.argmax(sims, axis=1)
    return {i: (int(j), pytest.approx(sims[i, j], abs=1e-8)) for i, j in enumerate(best) if np.isfinite(sims[i, j])}


@pytest.mark.parametrize("clustered", [True, False])
def test_dense_top1_with_pruned_cells(spark, clustered):
    """Large groups: the same answer, and on clustered vectors from few of the cells."""
    rng = np.random.default_rng(7)
    n = 2400
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(40, size=n)] + 0.15 * rng.standard_normal((n, 24)) if clustered else rng.standard_normal((n, 24)))
    x[100:400] = x[100]  # copies tie: the lowest index wins
    x[500:520] = 0
    labels = np.where(np.arange(n) % 10 == 9, 1, 0)  # one large group and a small one
    df = spark.createDataFrame([(int(g), i, v.tolist()) for i, (g, v) in enumerate(zip(labels, x))], "g int, i int, v array<double>").repartition(4)
    report = {}
    got = dense_top1(df, df.withColumnRenamed("i", "j"), group=["g"], sus_idx="i", src_idx="j", vec="v", block_rows=128, exclude_self=True, report=report)
    got = {r.i: (r.j, r.similarity) for r in got.collect()}
    assert got == _nearest_by_numpy(x, labels)
    assert report["cells"] > 0
    if clustered:
        assert report["cells_searched"] < 0.6 * report["cells"], report


def test_dense_top1_of_zero_vectors_and_nothing(spark):
    df = spark.createDataFrame([(0, i, [0.0, 0.0]) for i in range(50)], "g int, i int, v array<double>")
    got = dense_top1(df, df.withColumnRenamed("i", "j"), group=["g"], sus_idx="i", src_idx="j", vec="v", block_rows=8, exclude_self=True)
    assert {r.i: (r.j, r.similarity) for r in got.collect()} == {i: (0 if i else 1, 0.0) for i in range(50)}
    none = df.limit(0)
    assert dense_top1(none, none.withColumnRenamed("i", "j"), group=["g"], sus_idx="i", src_idx="j", vec="v").collect() == []
