"""

Every query reads the given tables whole (``benchmark`` passages are the
source corpus, every ``documents`` row is a suspicious document; see
``palimpsest.sources.tables``). Floating-point outputs are rounded to
``DECIMALS`` places in both engines so the value hashes compare across
summation orders.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import oracle as O
from palimpsest.functions.text import is_blank
from palimpsest.operators.sizing import reused
from palimpsest.operators.truth import detection_metrics
from palimpsest.plans import chunks as CH
from palimpsest.plans import dense as DN
from palimpsest.plans import text_queries as TQ
from palimpsest.plans.corpus import corpus_counts, detect_reuse
from palimpsest.sources.corpus import decode_text, sample_cap
from palimpsest.sources.sinks import metrics_lines
from palimpsest.sources.tables import (SOURCE_ID_FORMAT, SUSPICIOUS_ID_FORMAT, corpus_from_tables, phrase_document_counts, read_table,
                                        truth_from_tables)

try:  # the training-data operators and their pipeline are optional
    import corpus_pipeline
    from palimpsest.llm import registry as LLM
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "palimpsest.llm", "public_tokenizers"):
        raise
    corpus_pipeline = LLM = None

DECIMALS = 6
SF_SMOKE = os.environ.get("SPARK_ENTRY_SF_DIR", "/root/testdata/sf0.001")


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, DECIMALS).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _r(expr: str, name: str) -> str:
    return f"round({expr}, {DECIMALS}) AS {name}"


# ---------------------------------------------------------------- queries

def q_doc_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 flagship: documents x benchmark TF-IDF cosine >= 0.3 with truth."""
    return _round(_matches(spark, sf_dir, truth_from_tables(spark, sf_dir)), "similarity_score")


def _matches(spark, sf_dir, truth, stem=False, **options):
    return detect_reuse(corpus_from_tables(spark, sf_dir, with_truth=False), truth=truth, prep={"stem": stem}, **options)


def q_normalize_tokens(spark, sf_dir):
    """C1 over documents: token count and processed text."""
    return TQ.prepared_documents(spark, sf_dir)


def q_html_to_text(spark, sf_dir):
    """T2 over pages: visible text and processed text."""
    return TQ.html_pages(spark, sf_dir)


def q_sentence_chunks(spark, sf_dir):
    """T10 + T13 + T14: five-sentence chunks of every document."""
    return TQ.document_chunks(spark, sf_dir, "tfidf")


def q_sentence_chunks_dense(spark, sf_dir):
    """T11 + T13 + T14: one-sentence chunks of every document."""
    return TQ.document_chunks(spark, sf_dir, "dense")


def q_ngram_tf(spark, sf_dir):
    """V1 + V2: unigram and bigram counts per document."""
    return TQ.document_term_counts(spark, sf_dir)


def q_idf_table(spark, sf_dir):
    """V3: document frequency and smoothed IDF fitted on the benchmark passages."""
    return _round(TQ.source_idf(spark, sf_dir), "idf")


def q_tfidf_weights(spark, sf_dir):
    """V5 + V6: L2-normalised TF-IDF of every document under the source IDF."""
    return _round(TQ.suspicious_weights(spark, sf_dir), "w")


def q_truth_annotations(spark, sf_dir):
    """Derived ground truth: each document's verbatim benchmark passages in order."""
    return truth_from_tables(spark, sf_dir)


def q_detection_metrics(spark, sf_dir):
    """Precision / recall / F1 of the flagship matches against the truth."""
    truth = reused(truth_from_tables(spark, sf_dir))
    m = detection_metrics(_matches(spark, sf_dir, truth), truth)
    return _round(m, "precision", "recall", "f1_score")


def q_corpus_counts(spark, sf_dir):
    """Corpus sizes and match counts."""
    return corpus_counts(corpus_from_tables(spark, sf_dir, with_truth=False),
                         _matches(spark, sf_dir, truth_from_tables(spark, sf_dir)))


def _chunked(spark, sf_dir, stem=False):
    return CH.compare_chunked(corpus_from_tables(spark, sf_dir, with_truth=False), _pairs(spark, sf_dir), stem=stem)


def _pairs(spark, sf_dir):
    """The (suspicious, source) pairs that the derived truth names."""
    source = F.replace("source_reference", F.lit(".txt"), F.lit(""))
    return truth_from_tables(spark, sf_dir).select("suspicious_id", source.alias("source_id")).distinct()


def q_chunk_best_match(spark, sf_dir):
    """Best source chunk per suspicious chunk, with previews."""
    matches, _ = _chunked(spark, sf_dir)
    return _round(CH.chunk_report(matches), "similarity")


def q_chunk_flagged(spark, sf_dir):
    """Flagged chunk pairs with full texts."""
    matches, _ = _chunked(spark, sf_dir)
    return _round(CH.flagged_chunks(matches), "similarity")


def q_pair_summary(spark, sf_dir):
    """C3 summary: overall / max similarity, flagged and compared counts per pair."""
    _, summary = _chunked(spark, sf_dir)
    return _round(summary, "overall_similarity", "max_chunk_similarity")


def q_dense_best_match(spark, sf_dir):
    """J7/J5/J6 on precomputed vectors: nearest other vector of the same label."""
    return _round(DN.vector_nearest(read_table(spark, sf_dir, "embeddings")), "similarity")


def q_dense_summary(spark, sf_dir):
    """A1-A3 per label over the dense best matches."""
    best = DN.vector_nearest(read_table(spark, sf_dir, "embeddings"))
    return _round(DN.vector_summary(best), "overall_similarity", "max_chunk_similarity")


def q_hashed_embedding_match(spark, sf_dir):
    """C4 over the truth pairs with the built-in hashing embedder."""
    matches, _ = DN.compare_dense(corpus_from_tables(spark, sf_dir, with_truth=False), _pairs(spark, sf_dir))
    return _round(DN.dense_report(matches), "similarity")


def q_lsa_chunk_match(spark, sf_dir):
    """C4 over the truth pairs with the learned embedder (latent semantic analysis of the sources)."""
    matches, _ = DN.compare_lsa(corpus_from_tables(spark, sf_dir, with_truth=False), _pairs(spark, sf_dir))
    return _round(DN.dense_report(matches), "similarity")


def q_stemmed_similarity_join(spark, sf_dir):
    """C2 with Porter stemming of the vocabulary."""
    truth = truth_from_tables(spark, sf_dir)
    return _round(_matches(spark, sf_dir, truth, stem=True), "similarity_score")


def q_stemmed_chunk_match(spark, sf_dir):
    """C3 with Porter stemming: best source chunk per suspicious chunk, with previews."""
    matches, _ = _chunked(spark, sf_dir, stem=True)
    return _round(CH.chunk_report(matches), "similarity")


def q_word_tokens_split(spark, sf_dir):
    """T5 with the word tokenizer's contraction and punctuation splits over documents."""
    return TQ.word_token_splits(spark, sf_dir)


def q_token_stems(spark, sf_dir):
    """Every distinct token of the documents and its stem."""
    return TQ.token_stems(spark, sf_dir)


def q_doc_similarity_join_salted(spark, sf_dir):
    """C2 with the salted shuffle join forced, as for a source side too large to broadcast."""
    return _round(_matches(spark, sf_dir, truth_from_tables(spark, sf_dir), strategy="shuffle"), "similarity_score")


def q_doc_similarity_join_prefix(spark, sf_dir):
    """C2 with the prefix-filtered join forced, as for a large source side."""
    return _round(_matches(spark, sf_dir, truth_from_tables(spark, sf_dir), strategy="prefix"), "similarity_score")


def q_phrase_document_counts(spark, sf_dir):
    """Containment of short passages: documents per two-word phrase of the benchmark texts."""
    return phrase_document_counts(spark, sf_dir)


def q_abbreviations(spark, sf_dir):
    """Words of the documents that have a full stop, with counts and abbreviation scores."""
    return _round(TQ.abbreviation_words(spark, sf_dir), "score")


def q_sentence_chunks_learned(spark, sf_dir):
    """T12 + T13: five-sentence chunks, sentences split with abbreviations learned from the documents."""
    return TQ.learned_chunks(spark, sf_dir)


def q_trigram_tf(spark, sf_dir):
    """T15 + V2: three-word term counts per document."""
    return TQ.document_term_counts(spark, sf_dir, (3, 3))


def q_blank_documents(spark, sf_dir):
    """Documents blank after stripping, per source, of all."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.sum(is_blank("text").cast("long")).alias("n_blank"),
                                      F.count(F.lit(1)).alias("n_docs"))


def q_metrics_lines(spark, sf_dir):
    """K3: the metrics as the text lines of the reference's report."""
    return metrics_lines(q_detection_metrics(spark, sf_dir)).select(F.col("i").cast("long").alias("i"), F.col("value").alias("line"))


def q_pair_status(spark, sf_dir):
    """The status of a pair list that names unknown documents too: every labelled
    document with the benchmark item of the same number."""
    labels = read_table(spark, sf_dir, "labels")
    pairs = labels.select(F.format_string(SUSPICIOUS_ID_FORMAT, "doc_id").alias("suspicious_id"),
                          F.format_string(SOURCE_ID_FORMAT, "doc_id").alias("source_id"))
    return CH.pair_status(corpus_from_tables(spark, sf_dir, with_truth=False), pairs)


def q_corpus_rows_json(spark, sf_dir):
    """K1: the corpus as JSON rows."""
    corpus = corpus_from_tables(spark, sf_dir, with_truth=False).select("id", "type", "raw_text")
    return corpus.select("id", F.to_json(F.struct("id", "type", "raw_text")).alias("row_json"))


def q_decode_documents(spark, sf_dir):
    """documents' texts decoded from their bytes, with universal newlines."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", decode_text(F.encode("text", "UTF-8")).alias("raw_text"))


def q_sampled_corpus(spark, sf_dir):
    """The reference's default cap of 100 suspicious documents, filled
    source by source in a seeded hash order (a sampling operator)."""
    listing = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sample_cap(listing, 100, part="source", key="doc_id")


def entry(spark: SparkSession) -> DataFrame:
    return q_doc_similarity_join(spark, SF_SMOKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own_queries() | (LLM.queries() | {"pipeline": corpus_pipeline.run} if LLM else {})


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "doc_similarity_join": q_doc_similarity_join,
        "normalize_tokens": q_normalize_tokens,
        "html_to_text": q_html_to_text,
        "sentence_chunks": q_sentence_chunks,
        "sentence_chunks_dense": q_sentence_chunks_dense,
        "ngram_tf": q_ngram_tf,
        "idf_table": q_idf_table,
        "tfidf_weights": q_tfidf_weights,
        "truth_annotations": q_truth_annotations,
        "detection_metrics": q_detection_metrics,
        "corpus_counts": q_corpus_counts,
        "chunk_best_match": q_chunk_best_match,
        "chunk_flagged": q_chunk_flagged,
        "pair_summary": q_pair_summary,
        "dense_best_match": q_dense_best_match,
        "dense_summary": q_dense_summary,
        "hashed_embedding_match": q_hashed_embedding_match,
        "lsa_chunk_match": q_lsa_chunk_match,
        "stemmed_similarity_join": q_stemmed_similarity_join,
        "stemmed_chunk_match": q_stemmed_chunk_match,
        "token_stems": q_token_stems,
        "word_tokens_split": q_word_tokens_split,
        "sampled_corpus": q_sampled_corpus,
        "doc_similarity_join_salted": q_doc_similarity_join_salted,
        "doc_similarity_join_prefix": q_doc_similarity_join_prefix,
        "phrase_document_counts": q_phrase_document_counts,
        "abbreviations": q_abbreviations,
        "sentence_chunks_learned": q_sentence_chunks_learned,
        "trigram_tf": q_trigram_tf,
        "blank_documents": q_blank_documents,
        "metrics_lines": q_metrics_lines,
        "decode_documents": q_decode_documents,
        "pair_status": q_pair_status,
        "corpus_rows_json": q_corpus_rows_json,
    }


# ------------------------------------------------------------- oracle SQL

def _sql_doc_similarity_join(stem: bool = False) -> str:
    return ("WITH " + O.corpus_ctes(stem=stem) + "\nSELECT suspicious_id, source_id, "
            + _r("similarity_score", "similarity_score")
            + ", ground_truth, source_reference FROM matches")


def _sql_normalize_tokens() -> str:
    return (f"SELECT doc_id, len(tok)::BIGINT AS n_tokens, array_to_string(tok, ' ') AS processed_text "
            f"FROM (SELECT doc_id, {O.tokens_sql('text')} AS tok FROM documents)")


def _sql_html_to_text() -> str:
    text = O.strip_html_sql("lower(coalesce(html, ''))")
    return (f"SELECT page_id, {text} AS text, array_to_string({O.tokens_sql('html')}, ' ') "
            f"AS processed_text FROM pages")


def _sql_chunks(mode: str) -> str:
    if mode == "tfidf":
        sent = O.sentences_period_sql("text")
        whole = "translate(coalesce(text, ''), '!?', '..')"
        k, prev = 5, "left(chunk_text, 100) || '...'"
    else:
        sent = O.sentences_newline_sql("text")
        whole = "text"
        k, prev = 1, "CASE WHEN length(chunk_text) > 100 THEN left(chunk_text, 100) || '...' ELSE chunk_text END"
    return f"""
WITH s AS (SELECT doc_id, text, {sent} AS sent FROM documents),
c AS (SELECT doc_id, {O.chunks_sql('sent', k, whole)} AS ch FROM s),
u AS (SELECT doc_id, unnest(range(0, len(ch)))::INT AS chunk_idx, unnest(ch) AS chunk_text FROM c)
SELECT doc_id, chunk_idx, chunk_text, {prev} AS chunk_preview FROM u"""


def _sql_ngram_tf() -> str:
    return f"""
WITH t AS (SELECT doc_id, list_filter({O.tokens_sql('text')}, lambda x: length(x) >= 2) AS tok FROM documents)
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({O.terms_sql('tok')}) AS term FROM t)
GROUP BY doc_id, term"""


def _sql_idf_table() -> str:
    return f"""
WITH t AS (SELECT item_id, list_filter({O.tokens_sql('text')}, lambda x: length(x) >= 2) AS tok FROM benchmark),
tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({O.terms_sql('tok')}) AS term FROM t) GROUP BY item_id, term),
n AS (SELECT count(*) AS n FROM benchmark)
SELECT term, count(*) AS df, {_r('ln((1 + n) / (1 + count(*))) + 1', 'idf')} FROM tf, n GROUP BY term, n"""


def _sql_tfidf_weights() -> str:
    return ("WITH " + O.corpus_ctes() + "\nSELECT id AS suspicious_id, term, " + _r("w", "w")
            + " FROM sus_w")


def _sql_chunk_best_match(stem: bool = False) -> str:
    return ("WITH " + O.chunk_ctes(stem=stem) + "\nSELECT suspicious_id, source_id, suspicious_chunk_idx, "
            "left(suspicious_chunk_text, 100) || '...' AS suspicious_chunk_text, source_chunk_idx, "
            "left(source_chunk_text, 100) || '...' AS source_chunk_text, "
            + _r("similarity", "similarity") + " FROM matches")


def _sql_chunk_flagged() -> str:
    return ("WITH " + O.chunk_ctes() + "\nSELECT suspicious_id, source_id, suspicious_chunk_idx, "
            "suspicious_chunk_text, source_chunk_idx, source_chunk_text, "
            + _r("similarity", "similarity") + " FROM matches WHERE is_flagged")


def _sql_pair_summary() -> str:
    return ("WITH " + O.chunk_ctes() + "\nSELECT suspicious_id, source_id, "
            + _r("overall_similarity", "overall_similarity") + ", "
            + _r("max_chunk_similarity", "max_chunk_similarity")
            + ", flagged_chunks, compared_chunks FROM summary")


def _sql_dense_best_match() -> str:
    return ("WITH " + O.dense_ctes() + "\nSELECT label, sus AS suspicious_vec_id, src AS source_vec_id, "
            + _r("sim", "similarity") + ", sim >= 0.8 AS is_flagged FROM best")


def _sql_dense_summary() -> str:
    return ("WITH " + O.dense_ctes() + "\nSELECT label, " + _r("avg(sim)", "overall_similarity") + ", "
            + _r("max(sim)", "max_chunk_similarity")
            + ", count(*) FILTER (WHERE sim >= 0.8)::BIGINT AS flagged_chunks, "
              "count(*)::BIGINT AS compared_chunks FROM best GROUP BY label")


def _sql_hashed_embedding_match() -> str:
    def prev(c):
        return f"CASE WHEN length({c}) > 100 THEN left({c}, 100) || '...' ELSE {c} END"
    return ("WITH " + O.dense_text_ctes() + "\nSELECT b.suspicious_id, b.source_id, "
            "b.sus_idx AS suspicious_chunk_idx, " + prev("s.txt") + " AS suspicious_chunk_text, "
            "b.src_idx AS source_chunk_idx, " + prev("r.txt") + " AS source_chunk_text, "
            + _r("b.sim", "similarity") + ", b.sim >= 0.8 AS is_flagged "
            "FROM best b JOIN sus_c s ON s.doc = b.doc_id AND s.idx = b.sus_idx "
            "JOIN src_c r ON r.doc = b.item_id AND r.idx = b.src_idx")


def oracle_sql() -> dict[str, str]:
    return _own_oracle_sql() | (LLM.oracle_sql() if LLM else {}) | (
        {"pipeline": corpus_pipeline.ORACLE_SQL} if LLM and corpus_pipeline.ORACLE_SQL else {})


_SQL_PHRASES = """
WITH w AS (SELECT list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w)
SELECT phrase, count(doc_id)::BIGINT AS n_docs FROM p LEFT JOIN documents ON contains(text, phrase) GROUP BY phrase"""


def _sql_trigram_tf() -> str:
    return f"""
WITH t AS (SELECT doc_id, list_filter({O.tokens_sql('text')}, lambda x: length(x) >= 2) AS tok FROM documents)
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(range(1, len(tok) - 1),
  lambda i: tok[i] || ' ' || tok[i + 1] || ' ' || tok[i + 2])) AS term FROM t) GROUP BY doc_id, term"""


def _sql_metrics_lines() -> str:
    names = ("precision", "recall", "f1_score", "true_positives", "false_positives", "false_negatives")
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, '{n}: ' || {n}::VARCHAR AS line FROM ({O.metrics_sql()})"
                              for i, n in enumerate(names))


def _own_oracle_sql() -> dict[str, str]:
    return {
        "doc_similarity_join_salted": _sql_doc_similarity_join(),
        "doc_similarity_join_prefix": _sql_doc_similarity_join(),
        "stemmed_similarity_join": _sql_doc_similarity_join(stem=True),
        "stemmed_chunk_match": _sql_chunk_best_match(stem=True),
        "token_stems": O.token_stems_sql(),
        "word_tokens_split": O.word_tokens_split_sql(),
        "phrase_document_counts": _SQL_PHRASES,
        "abbreviations": "WITH " + O.abbreviation_ctes() + " SELECT * REPLACE (" + _r("score", "score").replace(" AS", " + 0.0 AS") + ") FROM scored WHERE n_stop > 0",
        "sentence_chunks_learned": O.learned_chunks_sql(),
        "trigram_tf": _sql_trigram_tf(),
        "metrics_lines": _sql_metrics_lines(),
        "blank_documents": ("SELECT source, sum((trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '')::BIGINT)::BIGINT "
                            "AS n_blank, count(*) AS n_docs FROM documents GROUP BY source"),
        "pair_status": (
            f"SELECT printf('{SUSPICIOUS_ID_FORMAT}', l.doc_id) AS suspicious_id, printf('{SOURCE_ID_FORMAT}', l.doc_id) AS source_id, "
            "CASE WHEN d.doc_id IS NOT NULL AND b.item_id IS NOT NULL THEN 'compared' WHEN b.item_id IS NOT NULL THEN 'missing_suspicious' "
            "WHEN d.doc_id IS NOT NULL THEN 'missing_source' ELSE 'missing_both' END AS status "
            "FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON b.item_id = l.doc_id"),
        "corpus_rows_json": (
            "SELECT id, '{\"id\":' || to_json(id) || ',\"type\":' || to_json(kind) || ',\"raw_text\":' || to_json(text) || '}' AS row_json FROM ("
            f"SELECT printf('{SOURCE_ID_FORMAT}', item_id) AS id, 'source' AS kind, text FROM benchmark UNION ALL "
            f"SELECT printf('{SUSPICIOUS_ID_FORMAT}', doc_id), 'suspicious', text FROM documents)"),
        "decode_documents": "SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS raw_text FROM documents",
        "doc_similarity_join": _sql_doc_similarity_join(),
        "normalize_tokens": _sql_normalize_tokens(),
        "html_to_text": _sql_html_to_text(),
        "sentence_chunks": _sql_chunks("tfidf"),
        "sentence_chunks_dense": _sql_chunks("dense"),
        "ngram_tf": _sql_ngram_tf(),
        "idf_table": _sql_idf_table(),
        "tfidf_weights": _sql_tfidf_weights(),
        "truth_annotations": O.truth_sql(),
        "detection_metrics": O.metrics_sql(),
        "corpus_counts": O.corpus_counts_sql(),
        "chunk_best_match": _sql_chunk_best_match(),
        "chunk_flagged": _sql_chunk_flagged(),
        "pair_summary": _sql_pair_summary(),
        "dense_best_match": _sql_dense_best_match(),
        "dense_summary": _sql_dense_summary(),
        "hashed_embedding_match": _sql_hashed_embedding_match(),
        "sampled_corpus": ("SELECT doc_id, source, n_chars FROM documents "
                           "ORDER BY source, md5('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100"),
    }
