"""op5: the token count query."""

import public_tokenizers
from pyspark.sql import functions as F

from palimpsest.llm.common import read
from palimpsest.llm.token_counts import token_counts

NAME = "op5_token_counts"
MODEL, LIMIT = "piece_bpe_32k.model", 4096


def query(spark, sf_dir):
    """Bytes and tokens of every document, and whether it is over the limit."""
    counts = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
