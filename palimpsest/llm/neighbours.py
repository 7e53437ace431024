"""Approximate nearest neighbours (largest inner product) by learned partitions.

Fit, on a bounded sample of distinct vectors (``sample_rows``, drawn by hash):

1. the sample's neighbour graph: each vector to its best ``degree`` others;
2. a balanced partition of that graph into a power of two of parts: halved again
   and again along its slowest-mixing direction, each cut then lowered by swaps of equally
   many vectors either way, so halves differ by one vector at most;
3. a small classifier (one hidden layer, softmax, numpy) that learns from a vector
   how its neighbours are spread over the parts.

Every row goes to its most probable part. A query goes to its ``probes`` most probable
parts and is compared with all of their rows, in blocks, in double precision. Its first part comes first:
the last of its best rows there is a bound below which rows of the other parts can't be among the best, so
they hand on little. ``probes`` isn't guessed: the exact neighbours of a bounded set of queries
(``measured_queries``) over all rows show in which of a query's parts they lie, and the fewest probes
that reach ``recall`` of them are taken. Vectors without structure need many.

Scores: candidates come from a matrix product; what can be among the best, within its rounding
error, is added up again component by component, so copies of a vector score alike wherever they lie.

Defined cases: rows with a null id, null, empty or zero vector or a component that is null or not finite take
no part; vectors of different lengths do not meet, and lengths other than the commonest are one part each,
searched whole; repeated rows stand each for themselves, a query excludes only its own row, equal scores go
by id; tables of fewer than ``2 * part_rows`` rows are one part; an empty table gives no rows; a product that
is not a number counts as minus infinity; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, record_batch, written
from palimpsest.llm.vectors import at_least, best, in_blocks, matrix, numbered, numpy_of, strips

FOUND = "q_rid long, score double, id long, rid long"
SEED = 42


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """For each row the places of its ``degree`` best others by inner product."""
    n = len(x)
    out = np.empty((n, min(degree, n - 1)), np.int64)
    for i, j in strips(n, n):
        s = x[i:j] @ x.T
        s[np.arange(j - i), np.arange(i, j)] = -np.inf
        out[i:j] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, :out.shape[1]] if n > 1 else 0
    return out


def _halve(a: np.ndarray, b: np.ndarray, n: int, rng, rounds: int = 40) -> np.ndarray:
    """Two halves (0/1) of ``n`` nodes with undirected edges ``a``-``b`` given both ways."""
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    v = rng.standard_normal(n)
    for _ in range(rounds):  # towards the slowest-mixing direction of a lazy walk
        v -= (degree * v).sum() / degree.sum()
        v = 0.5 * v + 0.5 * np.bincount(a, weights=v[b], minlength=n) / degree
        v /= np.linalg.norm(v) + 1e-300
    side = np.zeros(n, np.int8)
    side[np.argsort(v, kind="stable")[n // 2:]] = 1
    cut = (side[a] != side[b]).sum()
    share = 0.25
    while share > 0.01:
        away = np.bincount(a, weights=np.where(side[a] != side[b], 1.0, -1.0), minlength=n)
        zero, one = (s[np.argsort(-away[s], kind="stable")] for s in (np.flatnonzero(side == 0), np.flatnonzero(side == 1)))
        m = min(len(zero), len(one))
        gains = away[zero[:m]] + away[one[:m]]
        m = min(int((gains > 0).sum()), max(1, int(share * m)))
        if not m:
            break
        trial = side.copy()
        trial[zero[:m]], trial[one[:m]] = 1, 0
        after = (trial[a] != trial[b]).sum()
        if after < cut:
            side, cut = trial, after
        else:  # neighbours that swap together gain nothing: move fewer
            share /= 2
    return side


def balanced_parts(graph: np.ndarray, halvings: int, seed: int = SEED) -> np.ndarray:
    """Part of each node: ``2**halvings`` parts of equal size, give or take one a halving."""
    n = len(graph)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    for _ in range(halvings):
        new = part * 2
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (part[a] == p) & (part[b] == p)
            new[nodes] += _halve(place[a[inside]], place[b[inside]], len(nodes), rng)
        part = new
    return part


@dataclass
class Router:
    """The classifier: ``order`` gives the parts of each vector, most probable first."""

    weights: list[np.ndarray]
    parts: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros((len(x), 1))
        w1, b1, w2, b2 = self.weights
        return np.maximum(_scaled(x) @ w1 + b1, 0) @ w2 + b2

    def order(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Directions; a query's length does not change its order of candidates. Divided by the largest component first, as squares may overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(x.shape[1])).astype(np.float32)


def train_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 20,
                 batch: int = 256, rate: float = 2e-3, seed: int = SEED) -> Router:
    """Cross-entropy against the spread of each vector and its neighbours over the parts, by Adam."""
    if parts == 1:
        return Router([], 1)
    rng, n = np.random.default_rng(seed), len(x)
    near = np.concatenate([np.arange(n)[:, None], graph], axis=1)
    goal = np.zeros((n, parts), np.float32)
    np.add.at(goal, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1.0 / near.shape[1])
    x = _scaled(x)
    w = [rng.standard_normal((x.shape[1], hidden)).astype(np.float32) * np.float32(np.sqrt(2 / x.shape[1])), np.zeros(hidden, np.float32),
         rng.standard_normal((hidden, parts)).astype(np.float32) * np.float32(np.sqrt(1 / hidden)), np.zeros(parts, np.float32)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        deal = rng.permutation(n)
        for i in range(0, n, batch):
            xb, gb = x[deal[i:i + batch]], goal[deal[i:i + batch]]
            h = np.maximum(xb @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - gb) / len(xb)
            dh = (d @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((xb.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(w, parts)


def fit_router(base: DataFrame, dim: int, n: int, sample_rows: int, part_rows: int, max_parts: int, degree: int) -> Router:
    """Learned from at most ``sample_rows`` distinct vectors of length ``dim``, drawn by hash."""
    parts = 1
    while parts * 2 <= max_parts and n >= part_rows * parts * 2:
        parts *= 2
    if parts == 1:
        return Router([], 1)
    share, steps = min(1.0, 4 * sample_rows / n), 1 << 30
    drawn = base.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec"), F.lit(steps)) < F.lit(int(share * steps))))
    drawn = drawn.groupBy(F.xxhash64("vec").alias("h")).agg(F.first("vec").alias("vec")).orderBy("h").limit(sample_rows)
    x = np.array([r["vec"] for r in drawn.select("vec").collect()], np.float64)
    while parts > 1 and len(x) < 8 * parts:  # mostly copies: fewer parts
        parts //= 2
    if parts == 1:
        return Router([], 1)
    graph = neighbour_graph(x, degree)
    return train_router(x, graph, balanced_parts(graph, parts.bit_length() - 1), parts)


def _route(router: Router, dim: int, probes: int):
    """Rows to their parts, most probable first: as many as ``probes`` of a query, one of any other."""
    def run(batches):
        for batch in batches:
            lengths, query = batch.column("dim").to_numpy(), batch.column("query").to_pylist()
            for i, j in strips(batch.num_rows, router.parts + 256):
                part = batch.slice(i, j - i)
                out = [[-1] for _ in range(i, j)]
                at = np.flatnonzero(lengths[i:j] == dim)
                if len(at):
                    x = matrix(pa.chunked_array([part.column("vec").take(pa.array(at))]))
                    for p, order in zip(at, router.order(x)[:, :probes].tolist()):
                        out[p] = order if query[i + p] else order[:1]
                columns = {c: part.column(c) for c in ("rid", "id", "vec", "dim", "query")}
                yield record_batch(columns | {"parts": pa.array(out, pa.list_(pa.int32()))})

    return run


def _nearest(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list = []
        if queries.num_rows and rows.num_rows:
            q, x = matrix(queries.column("vec")), matrix(rows.column("vec"))
            own, rid, ident = numpy_of(queries, "rid"), numpy_of(rows, "rid"), numpy_of(rows, "id")
            least = numpy_of(queries, "least")
            with np.errstate(over="ignore", invalid="ignore"):
                rounding = 8 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(x, axis=1).max() * np.linalg.norm(q, axis=1)
                for i, j in strips(len(q), len(x)):
                    s = np.nan_to_num(q[i:j] @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    s[own[i:j, None] == rid[None, :]] = -np.inf
                    slack = np.nan_to_num(rounding[i:j], nan=np.inf, posinf=np.inf)
                    near = [u[at_least(row[u], k + 1, e)] for row, e, b in zip(s, slack, least[i:j])
                            for u in [np.flatnonzero(row >= b - e) if b > -np.inf else np.arange(len(row))]]
                    a = np.repeat(np.arange(i, j), [len(c) for c in near])
                    b = np.concatenate(near)
                    a, b = a[own[a] != rid[b]], b[own[a] != rid[b]]
                    score = np.zeros(len(a))
                    for d in range(x.shape[1]):
                        score += q[a, d] * x[b, d]
                    score[np.isnan(score)] = -np.inf
                    order = np.lexsort((rid[b], ident[b], -score, a))
                    a, b, score = a[order], b[order], score[order]
                    start = np.searchsorted(a, a)
                    top = np.arange(len(a)) - start < k
                    found.append((own[a[top]], score[top], ident[b[top]], rid[b[top]]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.array([])] * 4
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64(), from_pandas=False)
                         for n, c in zip(("q_rid", "score", "id", "rid"), columns)})

    return run


def probes_for(base: DataFrame, router: Router, dim: int, k: int, recall: float, measured_queries: int, block: int) -> tuple[int, float]:
    """The fewest probes with which a bounded set of queries finds ``recall`` of its exact
    neighbours among all rows, and the share found with them."""
    if router.parts == 1:
        return 1, 1.0
    asked = base.where(F.col("query") & (F.col("dim") == dim)).orderBy(F.xxhash64("rid")).limit(measured_queries)
    asked = written(asked.select("rid", "vec", "dim", F.lit(-math.inf).alias("least")))
    truth = best(in_blocks(base.where(F.col("dim") == dim).select("rid", "id", "vec", "dim"), asked, ["dim"], block, _nearest(k), FOUND), ["q_rid"], k)
    rows = truth.select("q_rid", "rid").join(base.select("rid", "vec"), "rid").select("q_rid", "vec").collect()  # measured_queries * k at most
    if not rows:
        return 1, 1.0
    queries = asked.collect()
    places = router.order(np.array([r["vec"] for r in queries], np.float64)).argsort(axis=1)
    own = {r["rid"]: p for r, p in zip(queries, places)}
    home = router.order(np.array([r["vec"] for r in rows], np.float64))[:, 0]
    place = np.array([own[r["q_rid"]][h] for r, h in zip(rows, home)])
    reached = np.cumsum(np.bincount(place, minlength=router.parts)) / len(place)
    probes = int(np.argmax(reached >= recall)) + 1
    return probes, float(reached[probes - 1])


def search(rows: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", recall: float = 0.95,
           sample_rows: int = 8192, part_rows: int = 1024, max_parts: int = 128, degree: int = 20,
           measured_queries: int = 256, block: int = 8192, report: dict | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query row, nearest first.
    ``report`` is filled with the parts, the probes and the recall measured for them."""
    base = numbered(rows, id, vector, query=F.coalesce(is_query, F.lit(False)))
    base = written(base.where(F.exists("vec", lambda x: x != 0)))
    lengths = base.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(1).collect()
    dim, n = (lengths[0]["dim"], lengths[0]["count"]) if lengths else (0, 0)
    router = fit_router(base, dim, n, sample_rows, part_rows, max_parts, degree)
    probes, reached = probes_for(base, router, dim, k, recall, measured_queries, block)
    if report is not None:
        report.update(rows=n, parts=router.parts, probes=probes, recall=reached)
    vec = base.schema["vec"].dataType.simpleString()
    routed = written(map_batches(base, _route(router, dim, probes), f"rid long, id long, vec {vec}, dim int, query boolean, parts array<int>"))
    index = routed.select("rid", "id", "vec", "dim", F.col("parts")[0].alias("part"))
    asked = routed.where("query").select("rid", "vec", "dim", F.posexplode("parts").alias("probe", "part"))
    asked = asked.withColumn("least", F.lit(-math.inf))
    found = best(in_blocks(index, asked.where("probe = 0").drop("probe"), ["dim", "part"], block, _nearest(k), FOUND), ["q_rid"], k)
    if probes > 1:
        first = written(found.drop("rank"))
        bound = first.groupBy(F.col("q_rid").alias("rid")).agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n"))
        bound = bound.where(F.col("n") == k).drop("n")
        others = asked.where("probe > 0").drop("probe").join(bound, "rid", "left").withColumn(
            "least", F.coalesce("bound", "least")).drop("bound")
        found = best(first.unionByName(in_blocks(index, others, ["dim", "part"], block, _nearest(k), FOUND)), ["q_rid"], k)
    names = routed.where("query").select(F.col("rid").alias("q_rid"), F.col("id").alias("query_id"))
    return names.join(found, "q_rid").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
