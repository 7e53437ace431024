"""Dense mode (C4/C9): chunk-level embedding comparison of document pairs,
and the same top-1 matching over precomputed vectors.

Chunks come from the newline sentence split (T11) with one sentence per
chunk by default and are embedded as raw text (no preprocessing), as the
reference feeds raw chunk text to its encoder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.sentences import explode_chunks, with_chunks
from palimpsest.functions.text import is_blank, preview
from palimpsest.operators.bestmatch import pair_summary
from palimpsest.operators.dense import HashingEmbedder, dense_top1, embed
from palimpsest.operators.lsa import fit_lsa, lsa_vectors
from palimpsest.operators.pairvectors import PAIR, with_source
from palimpsest.operators.sizing import broadcast_if_bounded, reused
from palimpsest.operators.vectorize import fit_idf, term_counts, tfidf_weights
from palimpsest.plans.chunks import ROWS_PER_SALT, document_chunk_units
from palimpsest.plans.corpus import with_terms
from palimpsest.session import text_partitions


def compare_dense(documents: DataFrame, pairs: DataFrame, threshold: float = 0.8,
                  chunk_size: int = 1, *, key: str = "id", text: str = "raw_text",
                  embedder_factory=HashingEmbedder, block_rows: int = 4096):
    """C4 over many pairs. Returns ``(matches, summary)`` like chunk mode;
    ``matches`` carries full chunk texts and ``is_flagged`` (>= threshold)."""
    pairs = reused(pairs.select(*PAIR).distinct())
    wanted = (pairs.select(F.col("suspicious_id").alias(key))
              .unionByName(pairs.select(F.col("source_id").alias(key))).distinct())
    docs = documents.join(wanted, key, "left_semi").repartition(
        text_partitions(documents.sparkSession), key)
    chunks = explode_chunks(with_chunks(docs.select(key, text), text, "dense", chunk_size).drop(text))
    chunks = reused(embed(chunks.filter(~is_blank("chunk_text")), "chunk_text", embedder_factory))

    def side(own: str, idx: str) -> DataFrame:
        return (pairs.join(chunks.withColumnRenamed(key, own), own)
                .select(*PAIR, F.col("chunk_idx").alias(idx), "embedding"))

    best = reused(dense_top1(side("suspicious_id", "suspicious_chunk_idx"),
                             side("source_id", "source_chunk_idx"), group=PAIR,
                             sus_idx="suspicious_chunk_idx", src_idx="source_chunk_idx",
                             block_rows=block_rows))
    return _with_texts(best, chunks, key, threshold), pair_summary(best, pairs, group=PAIR, threshold=threshold)


def _with_texts(best: DataFrame, chunks: DataFrame, key: str, threshold: float) -> DataFrame:
    """Best matches with both chunks' texts and ``is_flagged``."""
    def texts(side: str) -> DataFrame:
        return chunks.select(F.col(key).alias(f"{side}_id"), F.col("chunk_idx").cast("long").alias(f"{side}_chunk_idx"),
                             F.col("chunk_text").alias(f"{side}_chunk_text"))

    matches = best.join(texts("suspicious"), ["suspicious_id", "suspicious_chunk_idx"])
    return with_source(matches, texts("source"), ROWS_PER_SALT, ("source_chunk_idx",)).withColumn(
        "is_flagged", F.col("similarity") >= F.lit(float(threshold)))


def compare_lsa(documents: DataFrame, pairs: DataFrame, threshold: float = 0.8, ngram_range=(1, 2), chunk_size: int = 5, *,
                dim: int = 32, max_tokens: int | None = None, key: str = "id", text: str = "raw_text", prep: dict | None = None):
    """C4 with the learned embedder: chunks as in chunk mode, TF-IDF fitted on the source
    documents' chunks, vectors by latent semantic analysis of those. ``max_tokens`` cuts a chunk's tokens as the
    reference's encoder does (512); by default all count. Returns ``(matches, summary)``; chunks without a
    known term have the zero vector. ``documents`` needs ``type`` (source or suspicious)."""
    pairs = reused(pairs.select(*PAIR).distinct())
    wanted = (pairs.select(F.col("suspicious_id").alias(key))
              .unionByName(pairs.select(F.col("source_id").alias(key))).distinct())
    docs = documents.join(wanted, key, "left_semi").repartition(text_partitions(documents.sparkSession), key)
    chunks = reused(document_chunk_units(docs, key=key, text=text, chunk_size=chunk_size, **(prep or {})).filter("valid"))
    unit = [key, "chunk_idx"]
    tokens = F.slice("tokens", 1, max_tokens) if max_tokens else F.col("tokens")
    units = with_terms(chunks.select(*unit, tokens.alias("tokens")), ngram_range)
    tf = reused(term_counts(units, unit, F.col("terms")))
    sources = documents.filter(F.col("type") == "source").select(key)
    idf, _ = broadcast_if_bounded(fit_idf(tf.join(sources, key, "left_semi"), chunks.join(sources, key, "left_semi").select(*unit), []))
    weights = reused(tfidf_weights(tf, idf, unit, []))
    model = fit_lsa(weights.join(sources, key, "left_semi"), unit, dim)
    n = len(model.singular_values)
    zero = F.array_repeat(F.lit(0.0), max(n, 1))
    vectors = reused(chunks.select(*unit).join(lsa_vectors(weights, model, unit), unit, "left").withColumn(
        "embedding", F.when(F.size("embedding") > 0, F.col("embedding")).otherwise(zero)))

    def side(own: str, idx: str) -> DataFrame:
        return pairs.join(vectors.withColumnRenamed(key, own), own).select(*PAIR, F.col("chunk_idx").alias(idx), "embedding")

    best = reused(dense_top1(side("suspicious_id", "suspicious_chunk_idx"), side("source_id", "source_chunk_idx"), group=PAIR,
                             sus_idx="suspicious_chunk_idx", src_idx="source_chunk_idx"))
    return _with_texts(best, chunks, key, threshold), pair_summary(best, pairs, group=PAIR, threshold=threshold)


def dense_report(matches: DataFrame) -> DataFrame:
    """Per-chunk rows with previews that mark truncation only (dense mode)."""
    return matches.select(*PAIR, "suspicious_chunk_idx",
                          preview("suspicious_chunk_text", "if_truncated").alias("suspicious_chunk_text"),
                          "source_chunk_idx",
                          preview("source_chunk_text", "if_truncated").alias("source_chunk_text"),
                          "similarity", "is_flagged")


def vector_nearest(vectors: DataFrame, *, id_col: str = "vec_id", group_col: str = "label",
                   vec: str = "embedding", threshold: float = 0.8, block_rows: int = 4096) -> DataFrame:
    """Top-1 over precomputed vectors: for every vector the most similar
    other vector of the same group (ties to the lower id), flagged at
    ``threshold``. Output ``group_col, suspicious_vec_id, source_vec_id,
    similarity, is_flagged``."""
    v = vectors.select(group_col, id_col, vec)
    best = dense_top1(v, v.withColumnRenamed(id_col, "_src"), group=[group_col], sus_idx=id_col,
                      src_idx="_src", vec=vec,
                      block_rows=block_rows, exclude_self=True)
    return best.select(group_col, F.col(id_col).alias("suspicious_vec_id"),
                       F.col("_src").alias("source_vec_id"), "similarity",
                       (F.col("similarity") >= F.lit(float(threshold))).alias("is_flagged"))


def vector_summary(best: DataFrame, group_col: str = "label", threshold: float = 0.8) -> DataFrame:
    """A1-A3 per group of ``vector_nearest`` output."""
    return best.groupBy(group_col).agg(
        F.avg("similarity").alias("overall_similarity"),
        F.max("similarity").alias("max_chunk_similarity"),
        F.count_if(F.col("similarity") >= F.lit(float(threshold))).alias("flagged_chunks"),
        F.count(F.lit(1)).alias("compared_chunks"))
