"""Top-1 source unit per suspicious unit (J5) and per-pair summaries (A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Similarities are compared after rounding to this many decimals, so two
# equal cosines summed in different orders still tie and the lower source
# index wins, as argmax does.
TIE_DECIMALS = 10


def best_matches(pair_sims: DataFrame, sus_units: DataFrame, src_units: DataFrame, *,
                 group: list[str], sus_idx: str, src_idx: str) -> DataFrame:
    """Best source unit for every suspicious unit of every group.

    ``pair_sims(group..., sus_idx, src_idx, similarity)`` holds the pairs that
    share something; ``sus_units(group..., sus_idx)`` and
    ``src_units(group..., src_idx)`` list every valid unit. A suspicious unit
    with no positive similarity gets similarity 0.0 and the first valid source
    unit of its group. Groups without any valid source unit yield no rows.

    Ties on (rounded) similarity go to the lowest source index.
    """
    ranked = F.struct(F.round("similarity", TIE_DECIMALS), -F.col(src_idx))
    top = (pair_sims.groupBy(*group, sus_idx)
           .agg(F.max_by(F.struct(F.col(src_idx).alias("b_src"), F.col("similarity").alias("b_sim")),
                         ranked).alias("best")))
    first_src = src_units.groupBy(*group).agg(F.min(src_idx).alias("first_src"))
    return (sus_units.join(first_src, group)
            .join(top, [*group, sus_idx], "left")
            .select(*group, sus_idx,
                    F.coalesce(F.col("best.b_src"), F.col("first_src")).alias(src_idx),
                    F.coalesce(F.col("best.b_sim"), F.lit(0.0)).alias("similarity")))


def pair_summary(matches: DataFrame, pairs: DataFrame, *, group: list[str],
                 threshold: float) -> DataFrame:
    """A1-A3 per group: mean and max of best similarities, flagged and compared
    counts. Every group in ``pairs`` appears; groups with nothing compared get
    zeros (the reference's early-return result)."""
    agg = matches.groupBy(*group).agg(
        F.avg("similarity").alias("overall_similarity"),
        F.max("similarity").alias("max_chunk_similarity"),
        F.count_if(F.col("similarity") >= F.lit(float(threshold))).alias("flagged_chunks"),
        F.count(F.lit(1)).alias("compared_chunks"),
    )
    return (pairs.select(*group).distinct().join(agg, group, "left")
            .select(*group,
                    F.coalesce("overall_similarity", F.lit(0.0)).alias("overall_similarity"),
                    F.coalesce("max_chunk_similarity", F.lit(0.0)).alias("max_chunk_similarity"),
                    F.coalesce("flagged_chunks", F.lit(0)).cast("long").alias("flagged_chunks"),
                    F.coalesce("compared_chunks", F.lit(0)).cast("long").alias("compared_chunks")))
