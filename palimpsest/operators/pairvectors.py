"""TF-IDF of document pairs from per-document vectors.

Chunk mode fits one IDF per compared pair, on the chunks of both documents. A document's
part in that is the same in every pair it is in, so it is counted once:
its sorted term numbers, the number of its chunks with each, and its term counts by chunk, packed into one row
(``document_vectors``). For a pair the two sorted term arrays are united, chunk frequencies of shared terms added, weights and
norms follow, and the chunks of both sides are multiplied through their shared terms: no term is
counted, joined or shuffled per pair, and a pair leaves its task as one row per suspicious chunk.

Terms are numbered by their 64-bit hash. Pairs of one suspicious document go together in runs of about
``pairs_per_group``, so its vectors are sent once a run; a source in more than ``pairs_per_salt`` pairs
is copied, so that its pairs are dealt over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.bestmatch import TIE_DECIMALS
from palimpsest.operators.sizing import broadcast_if_bounded
from palimpsest.session import ship_package, text_partitions

PAIR = ["suspicious_id", "source_id"]
VECTOR = "chunks array<int>, terms array<long>, df array<int>, at array<int>, chunk array<int>, tf array<int>"
#: Cells of the chunk by chunk matrix, and products of term counts, worked on at once.
CELLS = 1 << 22


def _pack(key: str):
    def run(units: pa.Table) -> pa.Table:
        order = np.argsort(units.column("chunk_idx").to_numpy(), kind="stable")
        chunks = units.column("chunk_idx").to_numpy()[order]
        bags = units.column("bag").combine_chunks().take(pa.array(order))
        size = bags.value_lengths().to_numpy()
        hashed = bags.flatten().to_numpy()
        terms, at = np.unique(hashed, return_inverse=True)
        chunk = np.repeat(np.arange(len(chunks)), size)
        entry, tf = np.unique(chunk * max(len(terms), 1) + at, return_counts=True)
        chunk, at = np.divmod(entry, max(len(terms), 1))
        by_term = np.argsort(at, kind="stable")
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.table({key: units.column(key).slice(0, 1), "chunks": one(chunks, pa.int32()), "terms": one(terms, pa.int64()),
                         "df": one(np.bincount(at, minlength=len(terms)), pa.int32()), "at": one(at[by_term], pa.int32()),
                         "chunk": one(chunk[by_term], pa.int32()), "tf": one(tf[by_term], pa.int32())})

    return run


def document_vectors(units: DataFrame, terms: str = "terms", key: str = "id") -> DataFrame:
    """One row per document: its chunk numbers, distinct terms (sorted) with their chunk frequencies, and
    its counts as (place of the term, place of the chunk, tf), by term. ``units(key, chunk_idx, terms)``."""
    spark = units.sparkSession
    ship_package(spark)
    bags = units.select(key, "chunk_idx", F.transform(F.col(terms), lambda t: F.xxhash64(t)).alias("bag"))
    kind = units.schema[key].dataType.simpleString()
    return bags.repartition(text_partitions(spark), key).groupBy(key).applyInArrow(_pack(key), f"{key} {kind}, {VECTOR}")


def _side(table: pa.Table, i: int) -> dict[str, np.ndarray]:
    return {c: table.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("chunks", "terms", "df", "at", "chunk", "tf")}


def best_of_pair(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk of ``a`` the place of its best chunk of ``b`` (the first of equals) and their cosine."""
    n, n_b = len(a["chunks"]), len(b["chunks"])
    union = np.union1d(a["terms"], b["terms"])
    places, df = [np.searchsorted(union, x["terms"]) for x in (a, b)], np.zeros(len(union))
    for x, place in zip((a, b), places):
        df[place] += x["df"]
    idf = np.log((1 + n + n_b) / (1 + df)) + 1
    weights, terms = [], []
    for x, place, count in zip((a, b), places, (n, n_b)):
        term = place[x["at"]]
        w = x["tf"] * idf[term]
        norm = np.sqrt(np.bincount(x["chunk"], weights=w * w, minlength=count))
        weights.append(w / norm[x["chunk"]])
        terms.append(term)
    # entries of b are sorted by term: those that an entry of a meets are one run
    first, last = np.searchsorted(terms[1], terms[0]), np.searchsorted(terms[1], terms[0], side="right")
    by_chunk = np.argsort(a["chunk"], kind="stable")
    runs = (last - first)[by_chunk]
    start = np.searchsorted(a["chunk"][by_chunk], np.arange(n + 1))
    work = np.concatenate([[0], np.cumsum(runs)])[start] + np.arange(n + 1) * n_b  # products and cells up to each chunk
    best, score = np.zeros(n, np.int64), np.zeros(n)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + CELLS, side="right")) - 1)
        mine = by_chunk[start[lo]:start[hi]]
        length = (last - first)[mine]
        left = np.repeat(mine, length)
        right = np.arange(len(left)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[mine], length)
        cell = (a["chunk"][left].astype(np.int64) - lo) * n_b + b["chunk"][right]
        sims = np.bincount(cell, weights=weights[0][left] * weights[1][right], minlength=(hi - lo) * n_b).reshape(hi - lo, n_b)
        best[lo:hi] = np.argmax(np.round(sims, TIE_DECIMALS), axis=1)
        score[lo:hi] = sims[np.arange(hi - lo), best[lo:hi]]
        lo = hi
    return best, score


def _match(schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [] for name in schema.names}
        for i in range(left.num_rows):
            a = _side(left, i)
            for j in range(right.num_rows):
                b = _side(right, j)
                if len(a["chunks"]) and len(b["chunks"]):
                    best, score = best_of_pair(a, b)
                    n = len(best)
                    for name, values in zip(schema.names, ([left.column("suspicious_id")[i].as_py()] * n, [right.column("source_id")[j].as_py()] * n,
                                                           a["chunks"].tolist(), b["chunks"][best].tolist(), score.tolist())):
                        out[name] += values
        return pa.table(out, schema=schema)

    return run


def with_source(pairs: DataFrame, per_source: DataFrame, rows_per_salt: int, on: tuple[str, ...] = ()) -> DataFrame:
    """``pairs`` joined to ``per_source`` on ``source_id`` (and ``on``). Rows of a source in more than ``rows_per_salt``
    of them are dealt over salts, each with its own copy of what the source has."""
    counts = pairs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_salt)
    counts, _ = broadcast_if_bounded(counts.select("source_id", F.ceil(F.col("n") / rows_per_salt).cast("int").alias("_salts")))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    dealt = pairs.join(counts, "source_id", "left").withColumn("_salt", F.pmod(F.xxhash64("suspicious_id"), salts).cast("int"))
    copies = per_source.join(counts, "source_id", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.drop("_salts").join(copies.drop("_salts"), ["source_id", "_salt", *on]).drop("_salt")


def pair_best_matches(vectors: DataFrame, pairs: DataFrame, key: str = "id", pairs_per_group: int = 64,
                      pairs_per_salt: int = 1000) -> DataFrame:
    """``suspicious_id, source_id, suspicious_chunk_idx, source_chunk_idx, similarity``: the best source chunk of each
    suspicious chunk of each pair (see ``bestmatch``). Pairs without chunks on either side have no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = vectors.sparkSession
    ship_package(spark)
    runs = pairs.groupBy("suspicious_id").agg(F.ceil(F.count(F.lit(1)) / pairs_per_group).cast("int").alias("_runs"))
    dealt = pairs.join(runs, "suspicious_id").withColumn("_run", F.pmod(F.xxhash64("source_id"), F.col("_runs")).cast("int")).drop("_runs")
    right = with_source(dealt, vectors.withColumnRenamed(key, "source_id"), pairs_per_salt)
    left = vectors.withColumnRenamed(key, "suspicious_id").join(runs, "suspicious_id").withColumn(
        "_run", F.explode(F.sequence(F.lit(0), F.col("_runs") - 1))).drop("_runs")
    n, by = text_partitions(spark), ["suspicious_id", "_run"]
    ids = [pairs.schema[c] for c in PAIR]
    out = spark.createDataFrame([], f"{PAIR[0]} {ids[0].dataType.simpleString()}, {PAIR[1]} {ids[1].dataType.simpleString()}, "
                                    "suspicious_chunk_idx int, source_chunk_idx int, similarity double").schema
    left, right = (x.repartition(n, *by).toDF(*x.columns) for x in (left, right))  # named anew: both sides read ``vectors``
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        _match(to_arrow_schema(out)), out)
