"""TF-IDF weights as long tables (V2-V6).

A weight table has one row per (group..., unit, term) with the L2-normalised
TF-IDF weight ``w``. Groups are the IDF fitting scope: one global group for
corpus mode, one group per document pair for chunk mode.

Partitioning: callers hash-partition units by ``group + unit`` once (one
shuffle of the raw text). Term counting (groupBy unit, term) and the L2 norm
(window over unit) are then satisfied by that partitioning and add no
exchange; only the IDF (document frequency by term) and the term join move
data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ONE_GROUP = "_fit_scope"


def term_counts(units: DataFrame, keys: list[str], terms: Column) -> DataFrame:
    """V2: raw term frequency ``(keys..., term, tf)`` of each unit's term bag.

    ``explode_outer`` + a null filter instead of ``explode``: for ``explode``
    the optimizer infers ``size(terms) > 0`` and pushes it below an earlier
    repartition into the scan, which inlines (and so repeats) the whole
    tokenizer there.
    """
    return (units.select(*keys, F.explode_outer(terms).alias("term"))
            .filter(F.col("term").isNotNull())
            .groupBy(*keys, "term")
            .agg(F.count(F.lit(1)).alias("tf")))


def _scope(df: DataFrame, group: list[str]) -> tuple[DataFrame, list[str]]:
    if group:
        return df, group
    return df.withColumn(_ONE_GROUP, F.lit(0)), [_ONE_GROUP]


def fit_idf(tf: DataFrame, fitted_units: DataFrame, group: list[str]) -> DataFrame:
    """V3/V4: smoothed IDF ``ln((1 + n) / (1 + df)) + 1`` per (group..., term), with ``df``.

    ``n`` counts every fitted unit of the group, including units with no
    terms at all (a blank document still counts as a sample).
    """
    tf, g = _scope(tf, group)
    fitted_units, _ = _scope(fitted_units, group)
    n_units = fitted_units.groupBy(*g).agg(F.count(F.lit(1)).alias("n_units"))
    doc_freq = tf.groupBy(*g, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = (doc_freq.join(F.broadcast(n_units) if not group else n_units, g)
           .select(*g, "term", "df",
                   (F.log((F.col("n_units") + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    return idf if group else idf.drop(_ONE_GROUP)


def tfidf_weights(tf: DataFrame, idf: DataFrame, unit_keys: list[str], group: list[str]) -> DataFrame:
    """V5/V6: ``tf * idf`` for in-vocabulary terms, L2-normalised per unit.

    Out-of-vocabulary terms are dropped before the norm (inner join). A unit
    with no in-vocabulary term has no rows (its vector is zero).
    """
    joined = tf.join(idf, [*group, "term"])
    raw = F.col("tf") * F.col("idf")
    per_unit = Window.partitionBy(*group, *unit_keys)
    return (joined.select(*group, *unit_keys, "term", raw.alias("w"))
            .withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_unit))))


def vocabulary_weights(units: DataFrame, keys: list[str], terms: Column, idf: DataFrame,
                       parts: int | None = None) -> DataFrame:
    """V2+V5+V6 for units weighed against a broadcast vocabulary.

    Term occurrences are joined to the (broadcast) IDF table *before* they
    are counted, so out-of-vocabulary occurrences - most of them when the
    vocabulary is a small source collection - never reach the aggregation.
    Same result as ``tfidf_weights(term_counts(...), idf, ...)``. The counts are dealt out by unit, in
    ``parts`` parts if given, so that later sums per unit stay in tasks of a known size.
    """
    occurrences = (units.select(*keys, F.explode_outer(terms).alias("term"))
                   .filter(F.col("term").isNotNull())
                   .join(idf, "term"))
    raw = (occurrences.groupBy(*keys, "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
           .select(*keys, "term", (F.col("tf") * F.col("idf")).alias("w")))
    if parts:
        raw = raw.repartition(parts, *keys)
    per_unit = Window.partitionBy(*keys)
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_unit)))
