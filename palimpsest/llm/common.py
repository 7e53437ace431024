"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.sizing import broadcast_if_bounded, reused
from palimpsest.session import ensure_checkpoint_dir, ship_package, text_partitions

#: Fixed value: the ASCII white space that separates words in the contracts.
WS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def materialised(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder (see ``sizing.reused``)."""
    return reused(df)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared checkpoint folder: smaller
    than ``checkpoint()`` and read by column. Deleted when the application ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/palimpsest-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over all cores when the input has fewer splits than cores (one
    small file); larger inputs keep their splits and cost no shuffle."""
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() < sc.defaultParallelism:
        return df.repartition(text_partitions(df.sparkSession), *keys)
    return df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of one byte per character is plain ASCII,
    where ``lower`` does the same and is faster than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers, which give back what a task took."""
    ship_package(df.sparkSession)
    return df.mapInArrow(_released(fn), schema)


def _released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``fn``, and then freed memory back to the system: workers live on, stage after stage, and
    what their allocators keep would add up with the memory of the stages to come."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``max_bytes`` of ``column``, so
    working memory does not follow the batch size; a longer row stands alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def record_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def without(docs: DataFrame, gone: DataFrame, pairs: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows that match ``gone``; ``pairs`` maps columns of ``gone``
    to what they are compared with (nulls match nulls). ``gone`` is broadcast if its
    measured size allows, so the texts stay where they are; otherwise both sides are shuffled."""
    fresh = {name: f"_{uuid.uuid4().hex}" for name in pairs}
    gone, _ = broadcast_if_bounded(gone.select(*[F.col(a).alias(b) for a, b in fresh.items()]))
    same = F.lit(True)
    for name, value in pairs.items():
        same = same & value.eqNullSafe(F.col(fresh[name]))
    return docs.join(gone, same, "left_anti")
