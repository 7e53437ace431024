"""Sparse cosine similarity join.

Cosine of two L2-normalised sparse vectors = sum over shared terms of the
product of their weights, so the all-pairs comparison becomes an equi-join
of the two weight tables on ``term`` followed by a sum per unit pair. Pairs
that share no term never appear (their cosine is 0).

Physical shapes, picked by a measured size:

* **broadcast** - the source weights fit under the broadcast row limit. The
  suspicious side streams through a broadcast hash join in whatever
  partitioning it already has; when it is hash-partitioned by the suspicious
  unit, the pair sum needs no exchange at all.
* **salted shuffle** - both sides are large. A term whose posting list on
  either side exceeds ``rows_per_salt`` is hot: that side's postings are
  spread over buckets by a hash of the unit id and the other side's
  postings of the term are copied to each bucket (a grid when both sides
  are hot), so no task receives a whole hot posting list. Other terms join
  as usual. The source side travels as posting lists, so a suspicious posting meets one row
  a list and pairs are taken apart only where their suspicious unit's sums are made (see ``pair_sums``).
* **prefix filter** - large sides with a threshold (the ``auto`` choice
  when the source side is too big to broadcast): exact L2 prefix filtering
  keeps hot terms out of the join altogether (see ``prefix_filtered_pairs``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.sizing import bounded, broadcast_if_bounded, measured, reused
from palimpsest.session import text_partitions

#: Sources that share a term and travel in one row.
POSTINGS = 1000


def _salts(postings: DataFrame, group: list[str], rows_per_salt: int, name: str) -> DataFrame:
    counts = postings.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("n_post"))
    return (counts.filter(F.col("n_post") > rows_per_salt)
            .select(*group, "term",
                    F.ceil(F.col("n_post") / F.lit(rows_per_salt)).cast("int").alias(name)))


def salted_term_join(sus_w: DataFrame, src_w: DataFrame, group: list[str], sus_key: str,
                     src_key: str, rows_per_salt: int = 200_000) -> DataFrame:
    """Shuffle join on (group..., term, salt_a, salt_b) with hot terms split.

    A term hot on the suspicious side gets ``a`` buckets for its suspicious
    postings (by hash of the unit) and its source postings are copied to
    each; a term hot on the source side gets ``b`` buckets the same way the
    other round. A term hot on both sides is spread over an ``a x b`` grid,
    so every task sees at most ~``rows_per_salt`` postings of each side.
    """
    keys = [*group, "term"]
    hot = (_salts(sus_w, group, rows_per_salt, "a")
           .join(_salts(src_w, group, rows_per_salt, "b"), keys, "full_outer")
           .select(*keys, F.coalesce("a", F.lit(1)).alias("a"), F.coalesce("b", F.lit(1)).alias("b")))
    # at most (postings / rows_per_salt) hot terms per side: normally tiny
    hot, _ = broadcast_if_bounded(hot)

    def spread(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        own_n = F.coalesce(F.col(own), F.lit(1))
        other_n = F.coalesce(F.col(other), F.lit(1))
        return (df.join(hot, keys, "left")
                .withColumn("salt_" + own, F.pmod(F.xxhash64(F.col(key)), own_n).cast("int"))
                .withColumn("salt_" + other, F.explode(F.sequence(F.lit(0), other_n - 1)))
                .drop("a", "b"))

    sus = spread(sus_w, sus_key, "a", "b")
    src = spread(src_w, src_key, "b", "a")
    return sus.join(src, [*keys, "salt_a", "salt_b"]).drop("salt_a", "salt_b")


def pair_sums(sus_w: DataFrame, src_w: DataFrame, group: list[str], sus_key: str, src_key: str, out: str,
              rows_per_salt: int = 200_000) -> DataFrame:
    """``group..., sus_key, src_key, out``: the sum of products over shared terms, by the salted join.

    Joined by term, the products of a pair lie in many tasks, where adding them up early saves little. So sources are
    numbered and joined as lists of at most about ``POSTINGS`` of a term; a suspicious posting with the
    list it met goes to its unit's part, and only there it becomes a row per pair. Parts are as many as
    ``sus_w`` (materialised) has, since that was dealt out by the pairs to be expected."""
    spark = sus_w.sparkSession
    units, n_units, size = measured(src_w.select(*group, F.col(src_key).alias("_key")).distinct().withColumn("_src", F.monotonically_increasing_id()))
    few = F.broadcast if bounded(spark, n_units, size) else (lambda df: df)
    same = F.col(src_key).eqNullSafe(F.col("_key"))
    for g in group:
        same = same & F.col(f"s.{g}").eqNullSafe(F.col(f"u.{g}"))
    numbered = src_w.alias("s").join(few(units).alias("u"), same).select(*[F.col(f"s.{g}").alias(g) for g in group], "term", "_src", "w_src")
    lists = numbered.groupBy(*group, "term", F.pmod(F.xxhash64("_src"), F.lit(-(-n_units // POSTINGS) or 1)).alias("_list")).agg(
        F.collect_list(F.struct("_src", "w_src")).alias("_posts"))
    met = salted_term_join(sus_w, reused(lists), group, sus_key, "_list", rows_per_salt).select(*group, sus_key, "w_sus", "_posts")
    parts = max(text_partitions(spark), sus_w.rdd.getNumPartitions())
    pairs = met.repartition(parts, *group, sus_key).select(*group, sus_key, "w_sus", F.explode("_posts").alias("_p")).groupBy(
        *group, sus_key, F.col("_p._src").alias("_src")).agg(F.sum(F.col("w_sus") * F.col("_p.w_src")).alias(out))
    return pairs.join(few(units.select("_src", F.col("_key").alias(src_key))), "_src").select(*group, sus_key, src_key, out)


# Slack on the pruning bounds so rounding never drops a qualifying pair: we
# index and keep slightly more than the exact bounds require.
_BOUND_SLACK = 1e-9


def prefix_filtered_pairs(sus_w: DataFrame, src_w: DataFrame, *, sus_key: str, src_key: str,
                          group: list[str], threshold: float, rows_per_salt: int = 200_000,
                          max_broadcast_rows: int | None = None) -> DataFrame:
    """Exact ``similarity >= threshold`` pairs without the hot-term product.

    L2 prefix filtering (All-Pairs, Bayardo et al. 2007): order each source
    vector's terms hottest first (by source document frequency); the longest
    hot prefix whose L2 norm stays below ``threshold`` is left out of the
    index. A pair sharing no indexed term has cosine <= that norm <
    threshold (Cauchy-Schwarz), so candidates are the pairs sharing an
    indexed term. What is left of a pair is bounded by the unindexed norm of the
    source times the norm of the suspicious unit over terms left out anywhere; a
    candidate that cannot reach the threshold with that is pruned. The rest is
    verified in its own row: either side's unindexed terms are packed into one map per
    unit, and the two maps are zipped. Hot terms therefore never meet hot terms in a
    join, which is what makes the plain product quadratic at scale, and a candidate
    is one row throughout. Same output as ``cosine_pairs(..., threshold)``.
    """
    t = float(threshold)
    # numbered terms: joins compare one long, and a unit's vector packs into a map
    terms, _ = broadcast_if_bounded(src_w.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("_df"))
                                    .withColumn("_id", F.monotonically_increasing_id()), max_broadcast_rows)
    src = src_w.join(terms, [*group, "term"]).select(*group, src_key, F.col("_id").alias("term"), "w_src", "_df")
    sus = reused(sus_w.join(terms, [*group, "term"]).select(*group, sus_key, F.col("_id").alias("term"), "w_sus"))
    hot_first = Window.partitionBy(*group, src_key).orderBy(F.col("_df").desc(), F.col("term")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = src.withColumn("_cum", F.sqrt(F.sum(F.col("w_src") * F.col("w_src")).over(hot_first)))
    ranked, n, size = measured(ranked.select(*group, src_key, "term", "w_src", "_cum", (F.col("_cum") >= t - _BOUND_SLACK).alias("_indexed")))
    # what is made of it below takes no more
    few = F.broadcast if bounded(sus.sparkSession, n, size, max_broadcast_rows) else (lambda df: df)
    rest = ~F.col("_indexed")
    src_rest = few(ranked.groupBy(*group, src_key).agg(
        F.coalesce(F.max(F.when(rest, F.col("_cum"))), F.lit(0.0)).alias("_u_norm"),
        F.map_from_entries(F.collect_list(F.when(rest, F.struct("term", "w_src")))).alias("_u")))
    hot = few(ranked.where(rest).select(*group, "term").distinct())
    sus_rest = sus.join(hot, [*group, "term"], "left_semi").groupBy(*group, sus_key).agg(
        F.sqrt(F.sum(F.col("w_sus") * F.col("w_sus"))).alias("_h_norm"),
        F.map_from_entries(F.collect_list(F.struct("term", "w_sus"))).alias("_h"))

    indexed = ranked.filter("_indexed").select(*group, src_key, "term", "w_src")
    partial = pair_sums(sus, indexed, group, sus_key, src_key, "_partial", rows_per_salt)
    candidates = (partial.join(src_rest, [*group, src_key])
                  .filter(F.col("_partial") + F.col("_u_norm") >= F.lit(t - _BOUND_SLACK))
                  .join(sus_rest, [*group, sus_key], "left")
                  .filter(F.col("_partial") + F.col("_u_norm") * F.coalesce("_h_norm", F.lit(0.0)) >= F.lit(t - _BOUND_SLACK)))
    shared = F.map_values(F.map_zip_with("_u", "_h", lambda _, x, y: F.coalesce(x * y, F.lit(0.0))))
    more = F.coalesce(F.aggregate(shared, F.lit(0.0), lambda total, x: total + x), F.lit(0.0))
    return (candidates.select(*group, sus_key, src_key, (F.col("_partial") + more).alias("similarity"))
            .filter(F.col("similarity") >= F.lit(t)))


def cosine_pairs(sus_w: DataFrame, src_w: DataFrame, *, sus_key: str, src_key: str,
                 group: list[str] | None = None, threshold: float | None = None,
                 strategy: str = "auto", max_broadcast_rows: int | None = None,
                 rows_per_salt: int = 200_000) -> DataFrame:
    """Cosine similarity of every (suspicious, source) unit pair sharing a term.

    Inputs: ``sus_w(group..., <sus_key>, term, w)`` and
    ``src_w(group..., <src_key>, term, w)``, both L2-normalised.
    Output: ``(group..., sus_key, src_key, similarity)``; with ``threshold``
    only pairs with ``similarity >= threshold`` (J3/J6 predicate).

    ``threshold <= 0`` would ask for every pair including those sharing no
    term (the full product of both sides); that is refused rather than built.
    """
    group = list(group or [])
    if threshold is not None and threshold <= 0:
        raise ValueError("threshold must be > 0: a non-positive threshold selects the "
                         "full cross product of both sides, which is not built")
    sus = sus_w.withColumnRenamed("w", "w_sus")
    src = src_w.withColumnRenamed("w", "w_src")
    if strategy == "prefix":
        if threshold is None:
            raise ValueError("the prefix strategy needs a threshold")
        return prefix_filtered_pairs(sus, src, sus_key=sus_key, src_key=src_key, group=group,
                                     threshold=threshold, rows_per_salt=rows_per_salt,
                                     max_broadcast_rows=max_broadcast_rows)
    if strategy == "broadcast":
        joined = sus.join(F.broadcast(src), [*group, "term"])
    elif strategy == "shuffle":
        joined = None
        pairs = pair_sums(reused(sus), reused(src), group, sus_key, src_key, "similarity", rows_per_salt)
    elif strategy == "auto":
        src, small = broadcast_if_bounded(src, max_broadcast_rows)
        if not small and threshold is not None:
            return prefix_filtered_pairs(sus, src, sus_key=sus_key, src_key=src_key, group=group,
                                         threshold=threshold, rows_per_salt=rows_per_salt,
                                         max_broadcast_rows=max_broadcast_rows)
        joined = sus.join(src, [*group, "term"]) if small else None
        if not small:
            pairs = pair_sums(reused(sus), src, group, sus_key, src_key, "similarity", rows_per_salt)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    if joined is not None:
        pairs = (joined.groupBy(*group, sus_key, src_key)
                 .agg(F.sum(F.col("w_sus") * F.col("w_src")).alias("similarity")))
    if threshold is not None:
        pairs = pairs.filter(F.col("similarity") >= F.lit(float(threshold)))
    return pairs


def suggested_salt_rows(total_postings: int, partitions: int) -> int:
    """A posting-list length above which a term is treated as hot: twice the
    average rows per shuffle partition, at least 10k."""
    return max(10_000, 2 * math.ceil(total_postings / max(partitions, 1)))
