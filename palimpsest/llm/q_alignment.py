"""op12: the alignment query."""

import public_tokenizers

from palimpsest.llm.alignment import link_summary
from palimpsest.llm.common import read

NAME = "op12_alignment"
TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(spark, sf_dir):
    """Groups and links of every document's tokens under two tokenizers."""
    return link_summary(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B))
