"""op10: the quality rules query."""

from palimpsest.llm.common import read
from palimpsest.llm.quality import quality_rules

NAME = "op10_quality_rules"


def query(spark, sf_dir):
    """Base counts and verdict of every document."""
    return quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
