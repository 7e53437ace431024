"""Text preparation of a documents frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import (MINIMAL_STOPWORDS, join_tokens, remove_stopwords,
                                        word_tokens)
from palimpsest.operators.stemming import stem_token_arrays


def prepare_documents(documents: DataFrame, text_col: str = "raw_text", *, key: str = "id",
                      html: bool = True, stopwords=MINIMAL_STOPWORDS, stem: bool = True,
                      keep_tokens: bool = True) -> DataFrame:
    """Add ``tokens`` (array) and ``processed_text`` (tokens joined by a space).

    Order as in the reference: lower-case, strip markup, punctuation and
    digit runs to spaces, whitespace split, stop words out, stem, join.
    Stemming is a job over the vocabulary (see ``stemming``); ``stem=False`` leaves it out.
    """
    tokens = remove_stopwords(word_tokens(F.col(text_col), html=html), stopwords)
    out = documents.withColumn("tokens", tokens)
    if stem:
        out = stem_token_arrays(out, key=key, tokens_col="tokens")
    out = out.withColumn("processed_text", join_tokens("tokens"))
    return out if keep_tokens else out.drop("tokens")
