"""Hard negatives and nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import hard_negatives, neighbours, q_hard_negatives, q_neighbours

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in ("rid", "dim", "vec", "id", "score", "cell", "query", "_rows")]])  # names used inside


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, *["x"] * 8) for i, v, lab in rows],
                                 SCHEMA).repartition(parts)


def random_rows(n, dim, labels, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[rng.permutation(n)[:copies]] = x[0]
    return [(int(i), x[i].tolist(), int(rng.integers(labels))) for i in range(n)]


AWKWARD = [(100, None, 1), (200, [], 1), (300, [1.0, None], 1), (400, [math.nan, 1.0], 1), (500, [math.inf, 0.0], 2), (None, [1.0, 2.0], 1),
           (600, [1.0, 2.0], None), (700, [0.0, 0.0], 1), (800, [1.0, 2.0, 3.0], 1), (801, [3.0, 2.0, 1.0], 1), (802, [3.0, 2.0, 2.5], 2),
           (900, [1.0, 2.0], 1), (901, [1.0, 2.0], 1), (901, [1.0, 2.0], 1), (902, [0.5, 1.5], 2), (903, [0.25, 1.0], 3), (904, [-1.0, -2.0], 2),
           (1000, [-1.0, -2.0], 4), (1001, [1.0, 2.0], 4)]


def use(rows, zero):
    ok = [(i, v, lab) for i, v, lab in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    return [r for r in ok if zero or any(r[1])]


def brute_negatives(rows, positives, negatives):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in use(rows, True) if lab is not None]
    out = []
    for a, (i, v, lab) in enumerate(rows):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for b, (j, w, m) in enumerate(rows) if b != a and len(w) == len(v))
        for s, j, _ in [t for t in scored if t[2] == lab][:positives]:
            inside = [(-t, n) for t, n, m in scored if m != lab and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, j, k + 1, n, -s, t) for k, (t, n) in enumerate(inside[:negatives])]
    return sorted(out)


def mined(df, **options):
    rows = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows)


@pytest.mark.parametrize("positives,negatives,block", [(5, 10, 8192), (3, 2, 16), (7, 4, 50)])
def test_hard_negatives_like_brute_force(spark, positives, negatives, block):
    rows = random_rows(400, 6, 3, 1, copies=120)
    got = mined(frame(spark, rows), positives=positives, negatives=negatives, block=block)
    assert got == brute_negatives(rows, positives, negatives) and got


def test_hard_negatives_awkward_rows(spark):
    got = mined(frame(spark, AWKWARD), block=3)
    assert got == brute_negatives(AWKWARD, 5, 10)
    assert mined(frame(spark, [])) == []


def test_scores_beyond_exact_doubles():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**10, 1.0], [2.0**60, 0.0], [-(2.0**60), 0.0]])
    assert hard_negatives.whole_scores(a, b).tolist() == [[2**50 + 1, 2**53, -(2**53)]]


def test_hard_negatives_query_counts(spark):
    df = q_hard_negatives.query(spark, SF)
    assert set(df.columns) == {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"}
    assert df.groupBy("anchor_id", "positive_id").count().where("count > 10").count() == 0


def brute_nearest(rows, k, every):
    rows = use(rows, False)
    out = {}
    for a, (i, v, _) in enumerate(rows):
        if i % every == 0:
            scored = []
            for b, (j, w, _) in enumerate(rows):
                if b != a and len(w) == len(v):
                    s = 0.0
                    for x, y in zip(v, w):
                        s += float(np.float32(x)) * float(np.float32(y))
                    scored.append((-s, j))
            out.setdefault(i, []).append([(j, -s) for s, j in sorted(scored)[:k]])
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_one_part_is_exact(spark):
    rows = random_rows(300, 5, 2, 2, copies=100)
    got = found(neighbours.search(frame(spark, rows), F.col("vec_id") % 20 == 0, block=64))
    assert got == {i: lists[0] for i, lists in brute_nearest(rows, 20, 20).items()}


def test_awkward_vectors_and_an_empty_table(spark):
    got = found(neighbours.search(frame(spark, AWKWARD), F.col("vec_id") % 100 == 0, block=2))
    assert got == {i: lists[0] for i, lists in brute_nearest(AWKWARD, 20, 100).items() if lists[0]}
    assert found(neighbours.search(frame(spark, []), F.col("vec_id") % 20 == 0)) == {}


def test_learned_parts_reach_the_recall_asked_for(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 2
    x = (centres[rng.integers(12, size=3000)] + rng.standard_normal((3000, 16))).astype(np.float32)
    x[500:1500] = x[500]  # a third of all rows are copies
    rows = [(i, x[i].tolist(), 0) for i in range(3000)]
    report = {}
    got = found(neighbours.search(frame(spark, rows), F.col("vec_id") % 20 == 0, part_rows=200, sample_rows=1500, measured_queries=60,
                                  block=256, report=report))
    want = brute_nearest(rows, 20, 20)
    assert report["parts"] > 1 and report["probes"] < report["parts"] and report["recall"] >= 0.95
    assert all([j for j, _ in got[i]] == [j for j, _ in sorted(got[i], key=lambda t: (-t[1], t[0]))] and len(got[i]) == 20 for i in want)
    exact = {(i, j): s for i, lists in want.items() for j, s in lists[0]}
    assert all(exact[i, j] == s for i in want for j, s in got[i] if (i, j) in exact)
    hits = sum((i, j) in exact for i in want for j, _ in got[i])
    assert hits / len(exact) >= 0.9
    # a copy's neighbours are copies with the smallest ids
    assert [j for j, _ in got[1000]] == [j for j, _ in want[1000][0]]


def test_balanced_parts_and_their_cut():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 32))
    x = centres[np.arange(800) % 8] + 0.1 * rng.standard_normal((800, 32))
    graph = neighbours.neighbour_graph(x, 10)
    part = neighbours.balanced_parts(graph, 3)
    assert np.bincount(part).tolist() == [100] * 8
    assert (part[graph] == part[:, None]).mean() > 0.8
    router = neighbours.train_router(x, graph, part, 8)
    assert (router.order(x)[:, 0] == part).mean() > 0.8


def test_query_recall_on_the_given_table(spark):
    rows = found(q_neighbours.query(spark, "/root/testdata/sf0.1"))
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(table.embedding.values).astype(float)
    at = {v: i for i, v in enumerate(table.vec_id)}
    hits = 0
    for i, got in rows.items():
        s = x @ x[at[i]]
        s[at[i]] = -np.inf
        hits += len(set(table.vec_id.values[np.argsort(-s)[:20]]) & {j for j, _ in got})
    assert len(rows) == (table.vec_id % 20 == 0).sum() and hits >= 0.9 * 20 * len(rows)
