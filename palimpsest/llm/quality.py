"""Quality rules: base rules and robust multivariate outliers (DataFrame functions only).

Every document becomes a vector of transformed statistics. For each (language,
source) cell a minimum-covariance-determinant estimate is fitted by concentration
steps: distances under the current centre and covariance, the three quarters of the cell
(``SUPPORT``) with the least distances, centre and covariance of those, and
so on (``STEPS`` times) from a coordinate-wise median / interquartile start; so up to a quarter of
a cell may be outliers. ``FLOORS`` are added to the standard deviations (as variances): many cells have no scatter
at all in some statistic, where any other value would be infinitely far. A document is rejected if its squared
Mahalanobis distance from its cell exceeds ``CHI2_CUT``, the chi-square value that one in 10,000 exceeds.

Defined cases: a null text has no words (base rule fails); null ``lang`` or
``source`` are cells of their own; documents of a cell of fewer than ``MIN_CELL`` usable ones are judged by the
estimate over all usable documents of their language or, if these are too few, over all; documents that fail the base
rules take no part in the estimates; rows repeated stay separate rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import WS, materialised, spread
from palimpsest.operators.sizing import broadcast_if_bounded

#: Features of the vector, with the least standard deviation a cell is given in each.
FLOORS = {"f_len": 0.12, "f_sym": 0.2, "f_rep": 0.14, "f_dup": 0.16, "f_cap": 0.25}
SUPPORT, STEPS, MIN_CELL = 0.75, 3, 60
#: Median of chi-square with 5 degrees of freedom, and the value that one in 10,000 exceeds.
CHI2_MEDIAN, CHI2_CUT = 4.3515, 25.745


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, grams).otherwise(F.array().cast("array<bigint>"))


def base_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang, source`` and the base counts of every row."""
    s = F.coalesce(F.col(text), F.lit(""))
    d = spread(docs.select(F.col(key).alias("k"), "lang", "source", s.alias("t")), "k")
    d = d.select(
        "k", "lang", "source",
        F.char_length(F.regexp_replace("t", WS, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.filter(F.split("t", WS), lambda x: x != "").alias("words"))
    d = d.select("k", "lang", "source", "word_chars", "n_symbols", "n_capitals",
                 F.size("words").cast("long").alias("n_words"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.size("lines").cast("long").alias("n_lines"),
                 _repeat_words(F.col("words")).alias("grams"))
    twice = F.size(F.array_distinct("grams")) < F.size("grams")
    d = d.withColumn("sorted", F.when(twice, F.sort_array(
        F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    z = F.col("sorted")
    again = F.filter(F.transform(z, lambda x, j: F.when(
        (F.get(z, j - 1)["h"] == x["h"]) | (F.get(z, j + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull())
    d = d.withColumn("again", again)
    covered = F.size(F.array_distinct(F.concat(
        "again", F.transform("again", lambda p: p + 1), F.transform("again", lambda p: p + 2))))
    d = d.withColumn("n_repeat_words", F.when(F.col("sorted").isNull(), 0).otherwise(covered).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.drop("grams", "sorted", "again").withColumn("base_failed", failed)


def feature_columns() -> dict[str, Column]:
    """Transformed statistics: logarithms of rates and an arcsine of a share,
    with pseudo-counts so short texts do not scatter more than long ones."""
    n = F.col("n_words")
    return {
        "f_len": F.log((F.col("word_chars") + 100) / (n + 20)),
        "f_sym": F.log((F.col("n_symbols") + 4) / (n + 20)),
        "f_rep": F.asin(F.sqrt(F.col("n_repeat_words") / (n + 20))),
        "f_dup": F.asin(F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 4))),
        "f_cap": F.log((F.col("n_capitals") + 4) / (F.col("word_chars") + 20)),
    }


def _cells(rows: DataFrame) -> DataFrame:
    """Rows with the cell that they are judged in and the ``parts`` that they help to estimate: their own cell, and
    their language or all documents where smaller cells are judged by those."""
    ok = F.sum(F.when(~F.col("base_failed"), 1).otherwise(0))
    sizes = materialised(rows.groupBy("lang", "source").agg(ok.alias("n")))
    langs = materialised(sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.max(F.col("n") < MIN_CELL).alias("has_small")))
    some_rare = not langs.where(F.col("n_lang") < MIN_CELL).isEmpty()
    own, of_lang = F.to_json(F.struct(F.lit(2), F.col("s.lang"), F.col("s.source"))), F.to_json(F.struct(F.lit(1), F.col("s.lang")))
    big, common = F.col("n") >= MIN_CELL, F.col("n_lang") >= MIN_CELL
    parts = [F.when(big, own), F.when(common & F.col("has_small"), of_lang), *([F.lit("{}")] if some_rare else [])]
    named = sizes.alias("s").join(langs.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang"))).select(
        F.col("s.lang").alias("c_lang"), F.col("s.source").alias("c_source"),
        F.when(big, own).when(common, of_lang).otherwise("{}").alias("cell"), F.array_compact(F.array(*parts)).alias("parts"))
    named, _ = broadcast_if_bounded(named)
    return rows.join(named, F.col("lang").eqNullSafe(F.col("c_lang"))
                     & F.col("source").eqNullSafe(F.col("c_source"))).drop("c_lang", "c_source")


def _whitener(est: DataFrame) -> DataFrame:
    """The estimate as centre and Cholesky factor, floors added to the diagonal."""
    names = list(FLOORS)
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            v = F.col(f"c_{min(a, b)}_{max(a, b)}") + (F.lit(FLOORS[a] ** 2) if i == j else F.lit(0.0))
            for m in range(j):
                v = v - F.col(f"l_{i}_{m}") * F.col(f"l_{j}_{m}")
            est = est.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(v, F.lit(FLOORS[a] ** 2))) if i == j
                                 else v / F.col(f"l_{j}_{j}"))
    keep = [f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1)]
    return est.select("cell", *[f"m_{a}" for a in names], *keep)


def _with_distance(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Rows with ``d2``, the squared Mahalanobis distance from their cell."""
    white, _ = broadcast_if_bounded(_whitener(est))
    out = rows.join(white, "cell", "left")
    total = F.lit(0.0)
    for i, a in enumerate(FLOORS):
        y = F.col(a) - F.col(f"m_{a}")
        for j in range(i):
            y = y - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        out = out.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"y_{i}") * F.col(f"y_{i}")
    return out.withColumn("d2", total).select(*rows.columns, "d2")


def _start(rows: DataFrame) -> DataFrame:
    """Median and interquartile range per coordinate, no correlation."""
    q = [F.percentile_approx(a, [0.25, 0.5, 0.75], 10000).alias(f"q_{a}") for a in FLOORS]
    est = rows.groupBy("cell").agg(*q)
    for a in FLOORS:
        est = est.withColumn(f"m_{a}", F.col(f"q_{a}")[1])
        for b in FLOORS:
            if a <= b:
                spread_ = (F.col(f"q_{a}")[2] - F.col(f"q_{a}")[0]) / 1.349
                est = est.withColumn(f"c_{a}_{b}", spread_ * spread_ if a == b else F.lit(0.0))
    return est


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(
        *[F.avg(a).alias(f"m_{a}") for a in FLOORS],
        *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a in FLOORS for b in FLOORS if a <= b])


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the base counts, ``base_failed``, ``outlier_d2``
    (null without an estimate) and ``kept``."""
    rows = base_statistics(docs, key, text)
    for name, value in feature_columns().items():
        rows = rows.withColumn(name, value)
    rows = materialised(_cells(materialised(rows)))
    usable = rows.where(~F.col("base_failed") & (F.size("parts") > 0)).select(F.explode("parts").alias("cell"), *FLOORS)
    rows = rows.drop("parts")
    est = _start(usable)
    for _ in range(STEPS):
        near = _with_distance(usable, est)
        cut, _ = broadcast_if_bounded(near.groupBy("cell").agg(
            F.percentile_approx("d2", SUPPORT, 10000).alias("cut")))
        est = _moments(near.join(cut, "cell").where("d2 <= cut"))
    near = _with_distance(rows, est)
    # consistency: the median distance of a normal cell is known
    mid, _ = broadcast_if_bounded(_with_distance(usable, est).groupBy("cell").agg(
        F.percentile_approx("d2", 0.5, 10000).alias("mid")))
    scale = F.greatest(F.col("mid") / CHI2_MEDIAN, F.lit(1.0))
    judged = near.join(mid, "cell", "left").withColumn("outlier_d2", F.col("d2") / scale)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("outlier_d2"), F.lit(0.0)) <= CHI2_CUT)
    return judged.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", kept.alias("kept"), "outlier_d2", "lang", "source",
                         *FLOORS)
