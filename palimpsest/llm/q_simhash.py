"""op1: the SimHash query."""

from palimpsest.llm.common import read
from palimpsest.llm.simhash import simhash_dedup

NAME = "op1_simhash"


def query(spark, sf_dir):
    """Fingerprint and class of every document."""
    return simhash_dedup(read(spark, sf_dir, "documents")).drop("text_hash")
