"""Size-checked broadcast.

A side is broadcast only after its rows and bytes have been measured (one
aggregate) and found under the limits (``palimpsest.broadcast.maxRows`` and
``palimpsest.broadcast.maxBytes``); above either the caller takes the shuffle path. The measured frame is materialised first so the count and the
later join read the same materialised rows (checkpointed, see ``reused``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import broadcast_byte_limit, broadcast_row_limit, ensure_checkpoint_dir, text_partitions


def reused(df: DataFrame) -> DataFrame:
    """Materialise a frame that several branches of later plans read.

    ``checkpoint()`` writes it to the shared folder named by
    ``spark.checkpoint.dir`` and returns a frame whose plan is just that
    data: later plans stay small (adaptive execution re-optimises the whole
    logical plan after every stage, so long lineages cost seconds per
    stage), and lost executors re-read the files instead of recomputing
    the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes: its strings' bytes and eight for every other value (nested columns
    as JSON text, which is more than they take)."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + 16 + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            total = total + 8
    return total


def measured(df: DataFrame) -> tuple[DataFrame, int, int]:
    """Materialise ``df`` (see ``reused``) and return it with its rows and about its bytes."""
    df = reused(df)
    n, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return df, n, size or 0


def bounded(spark: SparkSession, rows: int, size: int, max_rows: int | None = None) -> bool:
    """Whether so many rows and bytes may be broadcast."""
    limit = broadcast_row_limit(spark) if max_rows is None else max_rows
    return rows <= limit and size <= broadcast_byte_limit(spark)


def broadcast_if_bounded(df: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Return ``(broadcast(df), True)`` when ``df`` is within both limits,
    else ``(df, False)``. ``df`` comes back materialised either way."""
    df, n, size = measured(df)
    if bounded(df.sparkSession, n, size, max_rows):
        return F.broadcast(df), True
    return df, False


#: Text handed to one task whose hash tables grow with it (term counts, pair sums).
PART_BYTES = 4 << 20


def text_parts(df: DataFrame, text: str, row_weight: int = 0) -> int:
    """How many parts of about ``PART_BYTES`` of column ``text`` (measured) ``df`` makes, each row counted ``row_weight``
    bytes larger. Dealt out by key in so many parts, what a task counts per key stays the same however large the
    input is: the number follows the input, and adaptive execution leaves a number asked for alone."""
    size = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + row_weight)).first()[0] or 0
    return max(text_partitions(df.sparkSession), -(-size // PART_BYTES))


def ensure_parallel(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition ``df`` by ``key`` when its input has fewer partitions
    than the cluster has cores (e.g. one large row group), so per-row text
    work is not serialised; inputs that already split well are left as they
    are and cost no shuffle."""
    spark = df.sparkSession
    if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        return df.repartition(text_partitions(spark), key)
    return df
