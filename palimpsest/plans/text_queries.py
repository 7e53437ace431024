"""Table-level text queries: preparation, HTML stripping, sentence chunking,
n-gram counts and TF-IDF weights over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.sentences import explode_chunks, with_chunks
from palimpsest.functions.text import (join_tokens, lower_html_text, preview, remove_stopwords,
                                       split_words, word_runs, word_tokens)
from palimpsest.operators.abbreviations import learned_sentences, scored_words, word_counts
from palimpsest.operators.sizing import ensure_parallel, reused, text_parts
from palimpsest.plans.corpus import corpus_weights, with_terms
from palimpsest.operators.stemming import stem_words
from palimpsest.operators.vectorize import fit_idf, term_counts
from palimpsest.sources.tables import corpus_from_tables, read_table


def prepared_documents(spark: SparkSession, sf_dir: str, html: bool = True) -> DataFrame:
    """C1 over ``documents``: ``doc_id, n_tokens, processed_text``."""
    docs = ensure_parallel(read_table(spark, sf_dir, "documents"), "doc_id")
    toks = remove_stopwords(word_tokens(F.col("text"), html=html))
    return (docs.select("doc_id", toks.alias("tokens"))
            .select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                    join_tokens("tokens").alias("processed_text")))


def word_token_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 with the word tokenizer's splits over ``documents``: ``doc_id, n_tokens, tokens``."""
    docs = ensure_parallel(read_table(spark, sf_dir, "documents"), "doc_id")
    return (docs.select("doc_id", split_words(F.lower("text")).alias("tok"))
            .select("doc_id", F.size("tok").cast("long").alias("n_tokens"), join_tokens("tok").alias("tokens")))


def token_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 over ``documents``: ``token, stem`` of every distinct token."""
    docs = ensure_parallel(read_table(spark, sf_dir, "documents"), "doc_id")
    toks = docs.select(F.explode_outer(remove_stopwords(word_tokens(F.col("text")))).alias("token"))
    return stem_words(toks.where(F.col("token").isNotNull()).distinct(), "token")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 over ``pages``: lower-cased visible text and its processed form."""
    pages = ensure_parallel(read_table(spark, sf_dir, "pages"), "page_id")
    stripped = pages.select("page_id", lower_html_text(F.col("html")).alias("text"))
    return stripped.withColumn("processed_text", join_tokens(remove_stopwords(word_runs("text"))))


def document_chunks(spark: SparkSession, sf_dir: str, mode: str = "tfidf",
                    chunk_size: int | None = None) -> DataFrame:
    """T10/T11 + T13 + T14 over ``documents``: one row per chunk
    ``doc_id, chunk_idx, chunk_text, chunk_preview``.

    ``tfidf`` mode: period split, 5 sentences per chunk, preview always ends
    in ``...``; ``dense`` mode: newline split, 1 sentence per chunk, preview
    only marks truncation."""
    docs = ensure_parallel(read_table(spark, sf_dir, "documents"), "doc_id")
    chunks = with_chunks(docs.select("doc_id", "text"), "text", mode, chunk_size).drop("text")
    style = "always" if mode == "tfidf" else "if_truncated"
    return (explode_chunks(chunks)
            .withColumn("chunk_preview", preview(F.col("chunk_text"), style)))


def abbreviation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12 over ``documents``: every word with a full stop somewhere, its counts and score."""
    docs = ensure_parallel(read_table(spark, sf_dir, "documents"), "doc_id")
    return scored_words(word_counts(docs)).where("n_stop > 0")


def learned_chunks(spark: SparkSession, sf_dir: str, chunk_size: int = 5) -> DataFrame:
    """T12 + T13 over ``documents``: chunks of sentences split with learned abbreviations."""
    docs = ensure_parallel(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    split = learned_sentences(docs, reused(scored_words(word_counts(docs))))
    chunks = with_chunks(split, "text", "dense", chunk_size, sentence_fn=lambda _: F.col("sentences")).drop("text", "sentences")
    return explode_chunks(chunks)


def document_term_counts(spark: SparkSession, sf_dir: str, ngram_range=(1, 2)) -> DataFrame:
    """V1/V2 over ``documents``: ``doc_id, term, tf``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.repartition(text_parts(docs, "text"), "doc_id")
    prepared = docs.withColumn("tokens", remove_stopwords(word_tokens(F.col("text"))))
    return term_counts(with_terms(prepared, ngram_range), ["doc_id"], F.col("terms"))


def source_idf(spark: SparkSession, sf_dir: str, ngram_range=(1, 2)) -> DataFrame:
    """V3 fitted on the ``benchmark`` passages: ``term, df, idf``."""
    bench = read_table(spark, sf_dir, "benchmark").repartition("item_id")
    prepared = bench.withColumn("tokens", remove_stopwords(word_tokens(F.col("text"))))
    tf = term_counts(with_terms(prepared, ngram_range), ["item_id"], F.col("terms"))
    return fit_idf(tf, bench.select("item_id"), []).select("term", "df", "idf")


def suspicious_weights(spark: SparkSession, sf_dir: str, ngram_range=(1, 2)) -> DataFrame:
    """V5/V6: L2-normalised TF-IDF of every document under the source IDF:
    ``suspicious_id, term, w``."""
    corpus = corpus_from_tables(spark, sf_dir, with_truth=False)
    sus_w, _ = corpus_weights(corpus, ngram_range, prep={"stem": False})
    return sus_w.withColumnRenamed("id", "suspicious_id")
