"""Sinks (K1-K5). All writes go through Spark's committers, so a retried
task or a lost executor cannot leave partial output behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT_BUCKETS = 64


def write_corpus(documents: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: the processed corpus. Parquet keeps the metadata struct; CSV
    (header, one row per document) stores it as JSON text."""
    if fmt == "parquet":
        documents.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        out = documents.drop("tokens")
        if "metadata" in out.columns:
            out = out.withColumn("metadata", F.to_json("metadata"))
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_matches(matches: DataFrame, path: str) -> None:
    """K2: detection results as CSV with a header (header-only when empty)."""
    matches.write.mode("overwrite").option("header", True).csv(path)


def metrics_lines(metrics: DataFrame) -> DataFrame:
    """K3 rows: one ``key: value`` line per metric, in the reference order."""
    keys = ["precision", "recall", "f1_score", "true_positives", "false_positives",
            "false_negatives"]
    pairs = ", ".join(f"{i}, '{k}', cast({k} as string)" for i, k in enumerate(keys))
    return (metrics.selectExpr(f"stack({len(keys)}, {pairs}) AS (i, k, v)")
            .select("i", F.concat_ws(": ", "k", "v").alias("value")))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """K3: the metrics as a single text file of ``key: value`` lines."""
    metrics_lines(metrics).coalesce(1).sortWithinPartitions("i").select("value") \
        .write.mode("overwrite").text(path)


def report_bucket(buckets: int = REPORT_BUCKETS) -> Column:
    """The bucket that a pair's rows are in."""
    return F.pmod(F.xxhash64(F.col("suspicious_id").cast("string"), F.col("source_id").cast("string")),
                  F.lit(buckets)).cast("int")


def write_chunk_report(report: DataFrame, path: str, buckets: int = REPORT_BUCKETS, max_rows: int = 1_000_000) -> None:
    """K4: per-chunk best matches (with previews) as CSV, in ``buckets`` folders by pair, files of at most ``max_rows`` rows.

    Rows are dealt by ranges of (bucket, pair, chunk), so a task writes neighbouring buckets, a pair's rows lie
    together and in order, and a pair with very many chunks is shared by several tasks. Null ids are values like others."""
    order = ["bucket", "suspicious_id", "source_id", *[c for c in report.columns if c == "suspicious_chunk_idx"]]
    rows = report.withColumn("bucket", report_bucket(buckets))
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").option("header", True).option("maxRecordsPerFile", max_rows).partitionBy("bucket").csv(path))


def read_chunk_report(spark: SparkSession, path: str, pairs: list[tuple] | None = None, schema: str | T.StructType | None = None,
                      buckets: int = REPORT_BUCKETS) -> DataFrame:
    """The chunk report of some (suspicious, source) pairs, opening their buckets only, or of all."""
    reader = spark.read.option("header", True)
    if schema is None:
        rows = reader.csv(path)
    else:
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        rows = reader.schema(T.StructType([*fields.fields, T.StructField("bucket", T.IntegerType())])).csv(path)
    if pairs is not None:
        wanted = spark.createDataFrame(pairs, "suspicious_id string, source_id string")
        used = [r["b"] for r in wanted.select(report_bucket(buckets).alias("b")).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(used)).join(F.broadcast(wanted.distinct()), ["suspicious_id", "source_id"], "left_semi")
    return rows.drop("bucket")


def write_flagged_report(flagged: DataFrame, summary: DataFrame, path: str,
                         params: dict | None = None) -> None:
    """K5: flagged chunk pairs with their pair summary and run parameters, as JSON lines."""
    out = flagged.join(summary, ["suspicious_id", "source_id"])
    for k, v in (params or {}).items():
        out = out.withColumn(f"param_{k}", F.lit(str(v)))
    out.write.mode("overwrite").json(path)
