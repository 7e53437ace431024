"""End-to-end jobs (C7-C9): load, prepare, detect, evaluate and write.

Every stage boundary that a later stage reads is a written table (the
processed corpus, the matches): it cuts lineage, so a lost executor late in
the job re-reads files instead of recomputing the corpus, and each output
is produced by Spark's task-retry-safe committers.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.truth import detection_metrics, loaded_truth, truth_cases
from palimpsest.plans.chunks import chunk_report, compare_chunked, flagged_chunks
from palimpsest.plans.corpus import corpus_counts, detect_reuse
from palimpsest.plans.dense import compare_dense, dense_report
from palimpsest.sources import sinks
from palimpsest.sources.corpus import load_corpus


def run_corpus_job(spark: SparkSession, corpus_root: str, output_dir: str, *,
                   max_src: int | None = None, max_sus: int | None = None,
                   threshold: float = 0.3, ngram_range=(1, 2), prep: dict | None = None,
                   seed: int = 42, restrict_to_loaded_sources: bool = False) -> dict[str, DataFrame]:
    """Corpus -> processed corpus (K1) -> matches (K2) -> metrics (K3).

    With ``restrict_to_loaded_sources`` only truth cases of loaded sources count (B5).

    Returns the written tables re-read as DataFrames plus the corpus counts (A7)."""
    corpus = load_corpus(spark, corpus_root, max_src=max_src, max_sus=max_sus, seed=seed,
                         prep=prep)
    corpus_path = os.path.join(output_dir, "processed_corpus")
    sinks.write_corpus(corpus.drop("tokens"), corpus_path)
    corpus = spark.read.parquet(corpus_path)

    matches_path = os.path.join(output_dir, "extrinsic_results")
    sinks.write_matches(detect_reuse(corpus, threshold, ngram_range), matches_path)
    matches = spark.read.option("header", True).schema(
        "suspicious_id string, source_id string, similarity_score double, "
        "ground_truth boolean, source_reference string").csv(matches_path)

    truth = truth_cases(corpus)
    if restrict_to_loaded_sources:
        truth = loaded_truth(truth, corpus.where("type = 'source'"))
    metrics = detection_metrics(matches, truth)
    sinks.write_metrics(metrics, os.path.join(output_dir, "evaluation_metrics"))
    return {"corpus": corpus, "matches": matches, "metrics": metrics,
            "counts": corpus_counts(corpus, matches)}


def run_pair_job(documents: DataFrame, pairs: DataFrame, output_dir: str, *, mode: str = "tfidf",
                 threshold: float | None = None, chunk_size: int | None = None,
                 ngram_range=(1, 2), embedder_factory=None) -> dict[str, DataFrame]:
    """C8 (``tfidf``) / C9 (``dense``): compare many document pairs chunk by
    chunk and write the per-chunk report (K4) and flagged report (K5)."""
    if mode == "tfidf":
        t = 0.3 if threshold is None else threshold
        k = 5 if chunk_size is None else chunk_size
        matches, summary = compare_chunked(documents, pairs, t, ngram_range, k)
        report = chunk_report(matches, "always")
        params = {"threshold": t, "ngram_range": ngram_range, "chunk_size": k}
    elif mode == "dense":
        t = 0.8 if threshold is None else threshold
        k = 1 if chunk_size is None else chunk_size
        kwargs = {"embedder_factory": embedder_factory} if embedder_factory else {}
        matches, summary = compare_dense(documents, pairs, t, k, **kwargs)
        report = dense_report(matches)
        params = {"threshold": t, "chunk_size": k}
    else:
        raise ValueError(f"unknown mode {mode!r}")
    sinks.write_chunk_report(report, os.path.join(output_dir, "chunk_similarities"))
    sinks.write_flagged_report(flagged_chunks(matches), summary,
                               os.path.join(output_dir, "flagged_chunks"), params)
    return {"matches": matches, "summary": summary, "report": report}
