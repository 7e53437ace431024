"""Vectors meeting a query set in bounded blocks (shared by the two vector operators).

Rows and queries carry a key (a label, a learned part, ...) and meet only at equal keys.
Inside a key both sides are dealt into blocks of about ``block`` vectors by a hash of
their row number; each pair of blocks is one group of a cogrouped join. So no task holds
more than one block of either side, however hot a key is, and what is shuffled is the rows
times the number of query blocks of their key plus the queries times its row blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import spread, written
from palimpsest.operators.sizing import broadcast_if_bounded
from palimpsest.session import ship_package, text_partitions


def usable(vector: Column) -> Column:
    """A vector with components, none of them null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def numbered(df: DataFrame, id: str, vector: str, **more: Column) -> DataFrame:
    """``rid, id, vec, dim`` and ``more`` of the usable rows, written once: the row number
    ``rid`` is read back, not made again, when a task is repeated."""
    kind = df.schema[vector].dataType.elementType.simpleString()
    vec = F.col(vector) if kind in ("float", "double") else F.col(vector).cast("array<double>")
    rows = df.where(F.col(id).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(id).cast("long").alias("id"), vec.alias("vec"), *[c.alias(n) for n, c in more.items()])
    return written(spread(rows).withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a double matrix."""
    n = len(column)
    flat = pa.chunked_array([c.flatten() for c in column.chunks]) if n else pa.chunked_array([], pa.float64())
    return flat.to_numpy().astype(np.float64).reshape(n, -1)


def numpy_of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def in_blocks(rows: DataFrame, queries: DataFrame, keys: list[str], block: int,
              fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn(queries, rows)`` for every pair of blocks with equal ``keys``; both sides have ``rid``."""
    spark = rows.sparkSession
    ship_package(spark)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(
        queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    blocks = counts.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_rows"),
                           F.ceil(F.col("_m") / block).cast("int").alias("_queries"))
    blocks, _ = broadcast_if_bounded(blocks)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        names = list(df.columns)
        mine = F.pmod(F.xxhash64(F.col("rid")), F.col(own)).cast("int")
        out = df.join(blocks, keys).select(*names, mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))
        # ``toDF`` names the columns anew: rows and queries may come from one frame
        return out.withColumn("cell", F.xxhash64(*keys, "_rows", "_queries")).toDF(*names, own, other, "cell")

    by = ["cell", *keys, "_rows", "_queries"]
    n = text_partitions(spark)
    left = dealt(queries, "_queries", "_rows").repartition(n, *by).groupBy(*by)
    right = dealt(rows, "_rows", "_queries").repartition(n, *by).groupBy(*by)
    return left.cogroup(right).applyInArrow(fn, schema)


def best(df: DataFrame, group: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group by falling ``score``, then ``id``, then ``rid``
    (each task keeps its own first ``k`` before the shuffle)."""
    w = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("id"), F.col("rid"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def at_least(row: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
    """Positions of the ``k`` highest values of ``row`` and of all within ``slack`` of the last of them."""
    if len(row) <= k:
        return np.arange(len(row))
    return np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - slack)


def strips(n: int, width: int, cells: int = 1 << 21):
    """Runs of rows of a score matrix of about ``cells`` cells."""
    step = max(1, cells // max(1, width))
    return ((i, min(n, i + step)) for i in range(0, n, step))
