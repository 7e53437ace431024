"""V7: a learned embedder, latent semantic analysis of the TF-IDF weights.

The truncated singular value decomposition of the (unit, term) weight matrix W by a randomised range finder (Halko,
Martinsson and Tropp, 2011), with all products as joins and sums over the long weight table:

1. ``S = W' R`` with random signs R per unit (bits of a hash of the unit, so nothing is stored);
2. ``power`` times ``S = W' (W S)``, which sharpens it towards the leading directions;
3. an orthonormal basis Q of S from its small Gram matrix, itself summed over partitions;
4. the Gram matrix of ``W Q`` and its eigenvectors U on the driver (``dim + oversample`` squared numbers); ``V = Q U``.

A unit's vector is its weights times V, one row per term, so embedding any other units is one join and one sum.
Only the small square matrices pass through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.sizing import broadcast_if_bounded, reused
from palimpsest.session import ship_package


@dataclass
class Lsa:
    """``terms(term, v)`` with ``v`` the term's row of V, and the singular values, largest first."""

    terms: DataFrame
    singular_values: np.ndarray


def _columns(n: int) -> list[str]:
    return [f"_v{i}" for i in range(n)]


def _times(weights: DataFrame, rows: DataFrame, on: list[str], to: list[str], n: int) -> DataFrame:
    """Sums of ``w`` times the ``n`` numbers of the row that ``on`` names, per ``to``."""
    rows, _ = broadcast_if_bounded(rows)
    return weights.join(rows, on).groupBy(*to).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in _columns(n)])


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _columns(n)]).astype(float)


def _gram(rows: DataFrame, n: int) -> np.ndarray:
    """``X' X`` of the rows' numbers, a partial sum per partition."""
    def run(batches):
        total = np.zeros((n, n))
        for batch in batches:
            x = _matrix(batch, n)
            total += x.T @ x
        i, j = np.indices((n, n))
        yield pa.RecordBatch.from_pydict({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "x": total.ravel()})

    ship_package(rows.sparkSession)
    out = np.zeros((n, n))
    for r in rows.select(*_columns(n)).mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # n * n
        out[r["i"], r["j"]] = r["x"]
    return out


def _rotated(rows: DataFrame, keys: list[str], n: int, by: np.ndarray) -> DataFrame:
    """The rows' numbers times the small matrix ``by``."""
    m = by.shape[1]

    def run(batches):
        for batch in batches:
            x = _matrix(batch, n) @ by
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(x[:, i]) for i in range(m)], names=[*keys, *_columns(m)])

    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} double" for c in _columns(m)])
    return rows.select(*keys, *_columns(n)).mapInArrow(run, schema)


def fit_lsa(weights: DataFrame, unit: list[str], dim: int = 32, oversample: int = 8, power: int = 1, seed: int = 42) -> Lsa:
    """From ``weights(unit..., term, w)``. Fewer than ``dim`` numbers a term if the weights have a lower rank."""
    weights, n = reused(weights.select(*unit, "term", "w")), dim + oversample

    def sign(i: int) -> Column:
        bits = F.xxhash64(*unit, F.lit(seed), F.lit(i // 64))
        return F.when(F.shiftrightunsigned(bits, i % 64).bitwiseAND(F.lit(1)) == 0, F.col("w")).otherwise(-F.col("w"))

    sketch = weights.groupBy("term").agg(*[F.sum(sign(i)).alias(c) for i, c in enumerate(_columns(n))])
    for _ in range(power):
        sketch = _times(weights, _times(weights, sketch, ["term"], unit, n), unit, ["term"], n)
    sketch = reused(sketch)
    size, directions = np.linalg.eigh(_gram(sketch, n))
    keep = size > 1e-12 * max(size.max(), 1e-300)
    if not keep.any():
        return Lsa(sketch.select("term", F.array().cast("array<double>").alias("v")).limit(0), np.zeros(0))
    basis = reused(_rotated(sketch, ["term"], n, directions[:, keep] / np.sqrt(size[keep])))
    m = int(keep.sum())
    values, turn = np.linalg.eigh(_gram(_times(weights, basis, ["term"], unit, m), m))
    best = np.argsort(-values)[:min(dim, m)]
    rows = _rotated(basis, ["term"], m, turn[:, best])
    return Lsa(reused(rows.select("term", F.array(*_columns(len(best))).alias("v"))), np.sqrt(np.maximum(values[best], 0)))


def lsa_vectors(weights: DataFrame, model: Lsa, unit: list[str], out: str = "embedding") -> DataFrame:
    """``unit..., out``: the vectors of units that share a term with the model."""
    n = len(model.singular_values)
    terms, _ = broadcast_if_bounded(model.terms)
    sums = weights.join(terms, "term").groupBy(*unit).agg(*[F.sum(F.col("w") * F.col("v")[i]).alias(c) for i, c in enumerate(_columns(n))])
    return sums.select(*unit, F.array(*_columns(n)).cast("array<double>").alias(out))
