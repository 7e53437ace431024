"""op2: the packing query."""

import public_tokenizers

from palimpsest.llm.common import read
from palimpsest.llm.packing import pack

NAME = "op2_packing"
TOKENIZER = "byte_bpe_50k.json"


def query(spark, sf_dir):
    """Every piece of every document."""
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
