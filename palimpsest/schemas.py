"""Declared schemas of the data model (documents, annotations, outputs)."""

from __future__ import annotations

from pyspark.sql import types as T

ANNOTATION_TYPE = T.StructType([
    T.StructField("source_reference", T.StringType()),
    T.StructField("offset", T.IntegerType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("obfuscation", T.StringType()),
])

METADATA_TYPE = T.StructType([
    T.StructField("authors", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("plagiarism", T.ArrayType(ANNOTATION_TYPE)),
])

DOCUMENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("raw_text", T.StringType()),
    T.StructField("processed_text", T.StringType()),
    T.StructField("metadata", METADATA_TYPE),
    T.StructField("has_plagiarism", T.BooleanType()),
])

DOC_MATCHES = T.StructType([
    T.StructField("suspicious_id", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("similarity_score", T.DoubleType()),
    T.StructField("ground_truth", T.BooleanType()),
    T.StructField("source_reference", T.StringType()),
])

METRICS = T.StructType([
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("true_positives", T.LongType()),
    T.StructField("false_positives", T.LongType()),
    T.StructField("false_negatives", T.LongType()),
    T.StructField("false_negatives_strict", T.LongType()),
])
