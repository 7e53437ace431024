"""op6: the exact deduplication query and its SQL."""

from palimpsest.llm.common import LOWER, UPPER, read
from palimpsest.llm.exact_dedup import exact_dedup

NAME = "op6_exact_dedup"


def query(spark, sf_dir):
    """Every row of documents with the row that stays of its equal texts."""
    return exact_dedup(read(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""
