"""Corpus mode: every suspicious document against every source document
(C2), its evaluation (C6) and corpus counts (A7).

Plan shape (sources small enough to broadcast, the common case of a
reference collection checked against a large incoming corpus):

1. suspicious documents are tokenised where they are read and their n-grams joined
   to the broadcast IDF, so only in-vocabulary term counts are shuffled (by id and
   term, after partial counting), never text;
2. the L2 norm (window by id) follows, in as many parts as keep the pairs of a part bounded;
3. the cosine join streams through the broadcast source weights, and the per-pair sum
   stays in its part: more documents make more parts, not larger hash tables.

With a large source side the term join becomes a salted shuffle join (see
``operators.simjoin``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ngrams import vectorizer_tokens, word_ngrams
from palimpsest.operators.prepare import prepare_documents
from palimpsest.operators.simjoin import cosine_pairs
from palimpsest.operators.sizing import broadcast_if_bounded, ensure_parallel, text_parts
from palimpsest.operators.truth import attach_truth, truth_cases
from palimpsest.operators.vectorize import (fit_idf, term_counts, tfidf_weights,
                                            vocabulary_weights)

#: What a possible pair counts beside the text when suspicious documents are dealt out: about a million to a part.
PAIR_BYTES = 4
VECTORIZER_TOKEN = r"[\p{L}\p{N}_]{2,}"


def with_terms(df: DataFrame, ngram_range=(1, 2)) -> DataFrame:
    """Add the vectorizer's term bag ``terms``: from ``tokens`` when the frame
    was prepared here, else re-tokenised from ``processed_text`` (runs of two
    or more word characters, lower-cased) - both give the same terms for
    prepared text. The token array is its own column so the n-gram
    expression reads it instead of re-running the tokenizer per reference."""
    if "tokens" in df.columns:
        toks = vectorizer_tokens(F.col("tokens"))
    else:
        toks = F.regexp_extract_all(F.lower(F.col("processed_text")), F.lit(VECTORIZER_TOKEN), 0)
    return (df.withColumn("_vt", toks)
            .withColumn("terms", word_ngrams(F.col("_vt"), ngram_range))
            .drop("_vt"))


def _side(documents: DataFrame, kind: str, key: str, prep: dict | None) -> DataFrame:
    """One side's texts where they were read (dealt out by ``key`` only when the
    input has fewer splits than cores); metadata does not travel with them."""
    text = [c for c in ("tokens", "processed_text", "raw_text") if c in documents.columns]
    side = ensure_parallel(documents.filter(F.col("type") == kind).select(key, *text), key)
    if "tokens" not in side.columns and "processed_text" not in side.columns:
        side = prepare_documents(side, key=key, **(prep or {}))
    return side


def corpus_weights(documents: DataFrame, ngram_range=(1, 2), *, key: str = "id",
                   prep: dict | None = None, max_broadcast_rows: int | None = None):
    """Fit IDF on the source documents, weight both sides.

    ``documents`` may be prepared (``tokens``/``processed_text``) or raw
    (``raw_text``; prepared here with ``prep`` options).
    Returns ``(sus_w, src_w)`` with columns ``(<key>, term, w)``.
    """
    src = _side(documents, "source", key, prep)
    sus = _side(documents, "suspicious", key, prep)
    src_tf = term_counts(with_terms(src, ngram_range), [key], F.col("terms"))
    idf, small_vocab = broadcast_if_bounded(fit_idf(src_tf, src.select(key), []), max_broadcast_rows)
    src_w = tfidf_weights(src_tf, idf, [key], [])
    if small_vocab:
        # count only in-vocabulary occurrences; stays inside the id partitioning
        sized = next((c for c in ("raw_text", "processed_text") if c in documents.columns), None)
        parts = sized and text_parts(documents.filter(F.col("type") == "suspicious"), sized, PAIR_BYTES * src.count())
        sus_w = vocabulary_weights(with_terms(sus, ngram_range), [key], F.col("terms"), idf, parts)
    else:
        sus_tf = term_counts(with_terms(sus, ngram_range), [key], F.col("terms"))
        sus_w = tfidf_weights(sus_tf, idf, [key], [])
    return sus_w, src_w


def detect_reuse(documents: DataFrame, threshold: float = 0.3, ngram_range=(1, 2), *,
                 match: str = "contains", strategy: str = "auto", prep: dict | None = None,
                 max_broadcast_rows: int | None = None, truth: DataFrame | None = None) -> DataFrame:
    """All (suspicious, source) document pairs with cosine >= threshold.

    ``documents`` needs ``id, type`` and ``processed_text``/``tokens`` or
    ``raw_text`` (prepared with ``prep`` options). Truth comes as ``truth``
    (rows as from ``truth_cases``) or as annotations in ``metadata``. Output:
    ``suspicious_id, source_id, similarity_score, ground_truth, source_reference``.
    """
    sus_w, src_w = corpus_weights(documents, ngram_range, prep=prep,
                                  max_broadcast_rows=max_broadcast_rows)
    pairs = cosine_pairs(sus_w.withColumnRenamed("id", "suspicious_id"),
                         src_w.withColumnRenamed("id", "source_id"),
                         sus_key="suspicious_id", src_key="source_id",
                         threshold=threshold, strategy=strategy,
                         max_broadcast_rows=max_broadcast_rows)
    matches = pairs.withColumnRenamed("similarity", "similarity_score")
    if truth is None and "metadata" in documents.columns:
        truth = truth_cases(documents)
    if truth is not None:
        return attach_truth(matches, truth, match=match, max_broadcast_rows=max_broadcast_rows)
    return (matches.withColumn("ground_truth", F.lit(False))
            .withColumn("source_reference", F.lit("")))


def corpus_counts(documents: DataFrame, results: DataFrame) -> DataFrame:
    """One row of total / source / suspicious document counts and
    match / confirmed-match counts."""
    docs = documents.select(F.lit(1).cast("long").alias("d"),
                            (F.col("type") == "source").cast("long").alias("s"),
                            (F.col("type") == "suspicious").cast("long").alias("u"),
                            F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("c"))
    res = results.select(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("s"),
                         F.lit(0).cast("long").alias("u"), F.lit(1).cast("long").alias("m"),
                         F.col("ground_truth").cast("long").alias("c"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in
            (("d", "documents"), ("s", "source_documents"), ("u", "suspicious_documents"),
             ("m", "matches"), ("c", "confirmed_matches"))]
    return docs.unionByName(res).agg(*sums)
