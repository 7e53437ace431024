"""op8: the language query."""

import public_tokenizers
from pyspark.sql import functions as F

from palimpsest.llm import langid
from palimpsest.llm.common import read

NAME = "op8_language_id"
VOCABULARY = "piece_bpe_32k.model"


def model_for(docs):
    return langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))),
                      public_tokenizers.path(VOCABULARY))


def query(spark, sf_dir):
    """The language of every document, learned from the rows not held out."""
    docs = read(spark, sf_dir, "documents")
    out = langid.predict(docs, public_tokenizers.path(VOCABULARY), model_for(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
