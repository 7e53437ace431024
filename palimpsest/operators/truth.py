"""Ground-truth annotations (J8) and detection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.sizing import broadcast_if_bounded, reused


def truth_cases(documents: DataFrame, id_col: str = "id") -> DataFrame:
    """Explode suspicious documents' ``metadata.plagiarism`` into
    ``(suspicious_id, ordinal, source_reference, offset, length, type, obfuscation)``;
    ``ordinal`` is the annotation's position in document order."""
    sus = documents.filter(F.col("type") == "suspicious")
    return (sus.select(F.col(id_col).alias("suspicious_id"),
                       F.posexplode("metadata.plagiarism").alias("ordinal", "ann"))
            .select("suspicious_id", "ordinal", "ann.source_reference", "ann.offset",
                    "ann.length", "ann.type", "ann.obfuscation"))


def attach_truth(matches: DataFrame, truth: DataFrame, match: str = "contains",
                 max_broadcast_rows: int | None = None) -> DataFrame:
    """``ground_truth`` and ``source_reference`` for each match.

    A match (suspicious_id, source_id) is confirmed by the first annotation
    of the same suspicious document (in document order) whose
    ``source_reference`` contains the source id (``match='contains'``, the
    reference's substring test) or equals it with ``.txt`` removed
    (``match='exact'``). Otherwise ``(False, '')``.

    Annotations are grouped into one ordered array per suspicious document
    and joined on ``suspicious_id``; the first hit is picked in-row, so the
    join neither duplicates matches nor needs a second aggregation. The
    per-document table is broadcast when its measured size allows.
    """
    per_doc = (truth.groupBy("suspicious_id")
               .agg(F.array_sort(F.collect_list(F.struct("ordinal", "source_reference")))
                    .alias("refs")))
    per_doc, _ = broadcast_if_bounded(per_doc, max_broadcast_rows)
    src = F.col("source_id").cast("string")
    if match == "contains":
        hit = lambda r: F.contains(r["source_reference"], src)
    elif match == "exact":
        hit = lambda r: F.replace(r["source_reference"], F.lit(".txt"), F.lit("")) == src
    else:
        raise ValueError(f"unknown match mode {match!r}")
    first = F.get(F.filter(F.col("refs"), hit), 0)
    out = matches.join(per_doc, "suspicious_id", "left")
    return (out.withColumn("_hit", first)
            .withColumn("ground_truth", F.col("_hit").isNotNull())
            .withColumn("source_reference", F.coalesce(F.col("_hit.source_reference"), F.lit("")))
            .drop("refs", "_hit"))


def loaded_truth(truth: DataFrame, sources: DataFrame, match: str = "contains", id_col: str = "id") -> DataFrame:
    """The truth cases whose source is among the loaded ``sources`` (``restrict_to_loaded_sources``), so that what a
    sample left out does not count as missed.

    ``exact``: the reference with ``.txt`` removed is a loaded id, one equi-join over distinct references.
    ``contains``: a loaded id occurs in the reference. Every substring of a reference of the length of some loaded id is
    looked up, so the join is an equi-join too; references are file names, and the lengths in use are few."""
    ids = sources.where(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")).select(
        F.col(id_col).cast("string").alias("_id")).distinct()
    refs = truth.where(F.col("source_reference").isNotNull()).select("source_reference").distinct()
    if match == "exact":
        keyed = refs.select("source_reference", F.replace("source_reference", F.lit(".txt"), F.lit("")).alias("_id"))
    elif match == "contains":
        lengths = sorted(r["n"] for r in ids.select(F.char_length("_id").alias("n")).distinct().collect())
        whole = F.char_length("source_reference")

        def substrings(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(whole - n + 1, F.lit(1)))
            return F.when(whole >= n, F.transform(starts, lambda i: F.substring("source_reference", i, F.lit(n)))).otherwise(none)

        none = F.array().cast("array<string>")
        keyed = refs.select("source_reference", F.explode_outer(
            F.array_distinct(F.concat(none, *[substrings(n) for n in lengths]))).alias("_id"))
    else:
        raise ValueError(f"unknown match mode {match!r}")
    found, _ = broadcast_if_bounded(keyed.join(ids, "_id", "left_semi").select("source_reference").distinct())
    return truth.join(found, "source_reference", "left_semi").select(*truth.columns)


def detection_metrics(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of precision, recall, F1 and counts.

    ``false_negatives`` keeps the reference's formula (distinct truth cases
    minus true-positive result rows, which can go negative when one case is
    hit by several sources); ``false_negatives_strict`` counts truth cases
    no result confirmed. Global aggregates return one row even when
    ``results`` is empty, which covers the reference's empty-result branch.
    """
    keys = ["suspicious_id", "source_reference"]
    gt = F.col("ground_truth")
    results = reused(results.select(*keys, "ground_truth"))  # read by two branches below
    result_rows = results.select(gt.cast("long").alias("tp"), (~gt).cast("long").alias("fp"),
                                 F.lit(0).cast("long").alias("n_case"),
                                 F.lit(0).cast("long").alias("n_missed"))
    cases = truth.select(*keys).distinct()
    hit_cases = (results.filter(gt).select(*keys).distinct()
                 .withColumn("_hit", F.lit(True)))
    case_rows = (cases.join(hit_cases, keys, "left")
                 .select(F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"),
                         F.lit(1).cast("long").alias("n_case"),
                         F.col("_hit").isNull().cast("long").alias("n_missed")))
    totals = result_rows.unionByName(case_rows).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "n_case", "n_missed")])
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("n_case") - tp
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    stats = totals.select(precision.alias("precision"), recall.alias("recall"), tp, fp,
                          fn.alias("fn"), "n_missed")
    p, r = F.col("precision"), F.col("recall")
    return stats.select(
        p.cast("double").alias("precision"), r.cast("double").alias("recall"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).cast("double").alias("f1_score"),
        F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"), F.col("n_missed").alias("false_negatives_strict"))
