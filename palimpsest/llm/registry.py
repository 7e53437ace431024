"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from palimpsest.llm import (q_alignment, q_exact_dedup, q_hard_negatives, q_langid, q_neighbours, q_packing, q_page_text, q_quality, q_repeats,
                            q_sampling, q_simhash, q_token_counts, q_toxicity)

MODULES = (q_exact_dedup, q_langid, q_packing, q_page_text, q_quality, q_repeats, q_sampling, q_simhash, q_token_counts, q_toxicity,
           q_hard_negatives, q_alignment, q_neighbours)


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict:
    return {m.NAME: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
