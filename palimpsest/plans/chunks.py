"""Chunk mode (C3/C8): chunk-level TF-IDF comparison of document pairs.

Input is a ``pairs(suspicious_id, source_id)`` frame plus the documents, so
any number of pairs run as one job. Each document is chunked, tokenised and counted
once (however many pairs it is in); its packed term vectors are joined to
its pairs, where the IDF is fitted on both sides' valid chunks (see
``operators.pairvectors``), as the reference fits one vectorizer per compared pair.

Per suspicious chunk the best source chunk is kept (top-1, ties to the lower
source index, no overlap -> similarity 0 with the first valid source
chunk). A pair summary gives the mean and max best similarity and the
flagged / compared chunk counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.sentences import explode_chunks, with_chunks
from palimpsest.functions.text import MINIMAL_STOPWORDS, preview, remove_stopwords, word_tokens
from palimpsest.operators.bestmatch import pair_summary
from palimpsest.operators.pairvectors import PAIR, document_vectors, pair_best_matches, with_source
from palimpsest.operators.sizing import reused
from palimpsest.operators.stemming import stem_token_arrays
from palimpsest.plans.corpus import with_terms
from palimpsest.session import text_partitions

#: Best-match rows of one source that may meet its texts in one task.
ROWS_PER_SALT = 100_000


def document_chunk_units(documents: DataFrame, *, key: str = "id", text: str = "raw_text",
                         mode: str = "tfidf", chunk_size: int | None = None,
                         html: bool = True, stopwords=MINIMAL_STOPWORDS, stem: bool = True) -> DataFrame:
    """Chunks of each document with their (stemmed) tokens:
    ``(key, chunk_idx, chunk_text, tokens, valid)``.

    ``valid`` is the reference's filter on chunks whose processed text is
    not blank (it keeps the original chunk index; nothing is renumbered)."""
    chunks = with_chunks(documents.select(key, text), text, mode, chunk_size).drop(text)
    units = explode_chunks(chunks)
    tokens = remove_stopwords(word_tokens(F.col("chunk_text"), html=html), stopwords)
    units = units.withColumn("tokens", tokens)
    if stem:
        units = stem_token_arrays(reused(units), key=[key, "chunk_idx"])
    return units.withColumn("valid", F.size("tokens") > 0)


def _pair_units(pairs: DataFrame, chunks: DataFrame, side: str, key: str) -> DataFrame:
    own = "suspicious_id" if side == "sus" else "source_id"
    return (pairs.join(chunks.filter("valid").withColumnRenamed(key, own), own)
            .select(*PAIR, F.lit(side).alias("side"), "chunk_idx", "tokens"))


def compare_chunked(documents: DataFrame, pairs: DataFrame, threshold: float = 0.3,
                    ngram_range=(1, 2), chunk_size: int = 5, *, key: str = "id",
                    text: str = "raw_text", html: bool = True,
                    stopwords=MINIMAL_STOPWORDS, stem: bool = True) -> tuple[DataFrame, DataFrame]:
    """C3 over many pairs. Returns ``(matches, summary)``.

    ``matches``: ``suspicious_id, source_id, suspicious_chunk_idx,
    source_chunk_idx, similarity, is_flagged, suspicious_chunk_text,
    source_chunk_text`` (full chunk texts; see ``chunk_report`` for previews).
    ``summary``: one row per pair (zeros when a side has no valid chunk).
    """
    pairs = reused(pairs.select(*PAIR).distinct())
    wanted = (pairs.select(F.col("suspicious_id").alias(key))
              .unionByName(pairs.select(F.col("source_id").alias(key))).distinct())
    spark = documents.sparkSession
    docs = documents.join(wanted, key, "left_semi").repartition(text_partitions(spark), key)
    chunks = reused(document_chunk_units(docs, key=key, text=text, chunk_size=chunk_size,
                                         html=html, stopwords=stopwords, stem=stem))

    units = with_terms(chunks.filter("valid"), ngram_range).select(key, "chunk_idx", "terms")
    vectors = reused(document_vectors(units, key=key))
    best = reused(pair_best_matches(vectors, pairs, key))
    texts = chunks.select(key, "chunk_idx", "chunk_text")
    matches = best.join(texts.select(F.col(key).alias("suspicious_id"), F.col("chunk_idx").alias("suspicious_chunk_idx"),
                                     F.col("chunk_text").alias("suspicious_chunk_text")), ["suspicious_id", "suspicious_chunk_idx"])
    source_texts = texts.select(F.col(key).alias("source_id"), F.col("chunk_idx").alias("source_chunk_idx"), F.col("chunk_text").alias("source_chunk_text"))
    matches = with_source(matches, source_texts, ROWS_PER_SALT, ("source_chunk_idx",))
    matches = matches.withColumn("is_flagged", F.col("similarity") >= F.lit(float(threshold)))
    summary = pair_summary(best, pairs, group=PAIR, threshold=threshold)
    return matches, summary


def chunk_report(matches: DataFrame, style: str = "always") -> DataFrame:
    """All best-match rows with 100-character previews (the per-chunk CSV)."""
    return matches.select(*PAIR, "suspicious_chunk_idx",
                          preview("suspicious_chunk_text", style).alias("suspicious_chunk_text"),
                          "source_chunk_idx",
                          preview("source_chunk_text", style).alias("source_chunk_text"),
                          "similarity")


def flagged_chunks(matches: DataFrame) -> DataFrame:
    """Flagged rows with the full chunk texts (the report's matched content)."""
    return (matches.filter("is_flagged")
            .select(*PAIR, "suspicious_chunk_idx", "suspicious_chunk_text",
                    "source_chunk_idx", "source_chunk_text", "similarity"))


def truth_pairs(documents: DataFrame, key: str = "id") -> DataFrame:
    """Pairs named by the suspicious documents' truth annotations
    (source id = reference file name without ``.txt``)."""
    return (documents.filter(F.col("type") == "suspicious")
            .select(F.col(key).alias("suspicious_id"),
                    F.explode_outer("metadata.plagiarism").alias("a"))
            .filter(F.col("a").isNotNull())
            .select("suspicious_id",
                    F.replace(F.col("a.source_reference"), F.lit(".txt"), F.lit("")).alias("source_id"))
            .distinct())


def pair_status(documents: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """Each pair with ``status``: ``compared``, or which of its documents is missing
    (``missing_suspicious``, ``missing_source``, ``missing_both``). A pair naming an unknown
    document has no similarity; its status tells that apart from no overlap."""
    def known(kind: str, name: str) -> DataFrame:
        return documents.filter(F.col("type") == kind).select(F.col(key).alias(name)).distinct().withColumn(
            f"_{name}", F.lit(True))

    found = pairs.join(known("suspicious", "suspicious_id"), "suspicious_id", "left").join(
        known("source", "source_id"), "source_id", "left")
    sus, src = F.col("_suspicious_id").isNotNull(), F.col("_source_id").isNotNull()
    status = (F.when(sus & src, "compared").when(src, "missing_suspicious")
              .when(sus, "missing_source").otherwise("missing_both"))
    return found.select("suspicious_id", "source_id", status.alias("status"))
