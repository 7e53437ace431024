"""op7: the suffix-array deduplication query."""

from palimpsest.llm.common import read
from palimpsest.llm.repeats import remove_repeats

NAME = "op7_suffix_dedup"


def query(spark, sf_dir):
    """What remains of every document without repeated 100-byte strings."""
    return remove_repeats(read(spark, sf_dir, "documents")).drop("o")


# Two hexadecimal digits stand for a byte.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS p,
             unnest(list_transform(range(0, length(h) // 2 - 99), lambda i: sha256(substr(h, 2 * i + 1, 200)))) AS s
      FROM d WHERE length(h) >= 200),
w AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM s),
e AS (SELECT doc_id, p, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM w WHERE r > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM e),
r AS (SELECT doc_id, span, min(p) AS lo, max(p) + 100 AS hi FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM r),
t AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS tail,
             string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""
