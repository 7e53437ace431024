"""Corpus-mode detection over a stream of incoming suspicious documents.

In corpus mode the IDF is fitted on the source documents only, so a
suspicious document's matches do not depend on the other suspicious
documents: scoring each micro-batch against fixed source weights gives
exactly the batch result. The source side (IDF table and L2-normalised
weights) is computed once and materialised; every micro-batch is prepared,
weighted and joined inside ``foreachBatch`` with the same operators as the
batch plan, and written with the batch id in its path so a replayed batch
overwrites its own output (idempotent, exactly-once with the checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.prepare import prepare_documents
from palimpsest.operators.simjoin import cosine_pairs
from palimpsest.operators.sizing import broadcast_if_bounded, reused
from palimpsest.operators.truth import attach_truth, truth_cases
from palimpsest.operators.vectorize import fit_idf, term_counts, tfidf_weights
from palimpsest.plans.corpus import with_terms


class SourceIndex:
    """Fitted source side: IDF table and normalised source weights."""

    def __init__(self, sources: DataFrame, ngram_range=(1, 2), prep: dict | None = None,
                 key: str = "id"):
        self.ngram_range, self.prep, self.key = ngram_range, prep or {}, key
        src = sources.repartition(key)
        if "tokens" not in src.columns:
            src = prepare_documents(src, key=key, **self.prep)
        tf = term_counts(with_terms(src, ngram_range), [key], F.col("terms"))
        self.idf, _ = broadcast_if_bounded(fit_idf(tf, src.select(key), []))
        self.weights = reused(tfidf_weights(tf, self.idf, [key], []))

    def score(self, suspicious: DataFrame, threshold: float = 0.3,
              match: str = "contains") -> DataFrame:
        """C2 for a batch of suspicious documents against the fitted sources."""
        key = self.key
        sus = suspicious.repartition(key)
        if "tokens" not in sus.columns:
            sus = prepare_documents(sus, key=key, **self.prep)
        tf = term_counts(with_terms(sus, self.ngram_range), [key], F.col("terms"))
        sus_w = tfidf_weights(tf, self.idf, [key], [])
        pairs = cosine_pairs(sus_w.withColumnRenamed(key, "suspicious_id"),
                             self.weights.withColumnRenamed(key, "source_id"),
                             sus_key="suspicious_id", src_key="source_id", threshold=threshold)
        matches = pairs.withColumnRenamed("similarity", "similarity_score")
        if "metadata" in suspicious.columns:
            truth = truth_cases(suspicious.withColumn("type", F.lit("suspicious")), key)
            return attach_truth(matches, truth, match=match)
        return (matches.withColumn("ground_truth", F.lit(False))
                .withColumn("source_reference", F.lit("")))


def start_detection_stream(index: SourceIndex, suspicious_stream: DataFrame, output_path: str,
                           checkpoint_location: str, threshold: float = 0.3,
                           trigger: dict | None = None):
    """Start a streaming query that writes the matches of every micro-batch
    of ``suspicious_stream`` (columns ``id, raw_text[, metadata]``) under
    ``output_path/batch_id=<n>``. Returns the ``StreamingQuery``."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (index.score(batch, threshold)
         .write.mode("overwrite").parquet(f"{output_path.rstrip('/')}/batch_id={batch_id}"))

    writer = (suspicious_stream.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_location))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
