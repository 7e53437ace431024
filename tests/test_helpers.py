import pytest
from pyspark.sql import functions as F

from palimpsest.functions.ngrams import word_ngrams
from palimpsest.operators.vectorize import fit_idf, term_counts, tfidf_weights, vocabulary_weights
from palimpsest.sources.corpus import sample_cap
from palimpsest.sources.sinks import metrics_lines


def test_vocabulary_weights_equal_full_weights(spark):
    src = spark.createDataFrame([(1, ["aa", "bb", "cc"]), (2, ["bb", "dd"]), (3, [])],
                                "id int, tokens array<string>")
    sus = spark.createDataFrame([(10, ["aa", "bb", "zz", "bb"]), (11, ["qq"]), (12, ["dd", "dd"])],
                                "id int, tokens array<string>")
    tf = term_counts(src, ["id"], word_ngrams(F.col("tokens")))
    idf = fit_idf(tf, src.select("id"), [])
    full = tfidf_weights(term_counts(sus, ["id"], word_ngrams(F.col("tokens"))), idf, ["id"], [])
    fast = vocabulary_weights(sus, ["id"], word_ngrams(F.col("tokens")), F.broadcast(idf))
    a = {(r.id, r.term): r.w for r in full.collect()}
    b = {(r.id, r.term): r.w for r in fast.collect()}
    assert a.keys() == b.keys() and a
    for k in a:
        assert b[k] == pytest.approx(a[k])
    n = {r.term: r.idf for r in idf.collect()}
    assert n["bb"] == pytest.approx(1.0 + 0.2876820724517809)  # ln(4/3) + 1: n = 3 incl. the blank


def test_sample_cap_is_deterministic_and_part_ordered(spark):
    rows = [(i, f"p{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, part string")
    a = sorted(r.id for r in sample_cap(df, 12, part="part", key="id").collect())
    b = sorted(r.id for r in sample_cap(df.repartition(7), 12, part="part", key="id").collect())
    assert a == b and len(a) == 12
    parts = sorted(f"p{i % 3}" for i in a)
    assert parts == ["p0"] * 10 + ["p1"] * 2
    assert sample_cap(df, None) is df


def test_metrics_lines_format(spark):
    m = spark.createDataFrame([(0.5, 1.0, 2 / 3, 1, 1, 0)],
                              "precision double, recall double, f1_score double, true_positives long, "
                              "false_positives long, false_negatives long")
    lines = [r.value for r in metrics_lines(m).orderBy("i").collect()]
    assert lines == ["precision: 0.5", "recall: 1.0", "f1_score: 0.6666666666666666",
                     "true_positives: 1", "false_positives: 1", "false_negatives: 0"]


def test_empty_sides(spark):
    from palimpsest.operators.truth import detection_metrics, truth_cases
    from palimpsest.plans.chunks import compare_chunked
    from palimpsest.plans.corpus import detect_reuse

    schema = "id string, type string, raw_text string"
    only_sus = spark.createDataFrame([("u1", "suspicious", "alpha beta")], schema)
    assert detect_reuse(only_sus).count() == 0
    blank_src = spark.createDataFrame([("s1", "source", "  !! 42 "), ("u1", "suspicious", "alpha")], schema)
    assert detect_reuse(blank_src).count() == 0
    only_src = spark.createDataFrame([("s1", "source", "alpha beta")], schema)
    res = detect_reuse(only_src)
    assert res.count() == 0
    truth = spark.createDataFrame([], "suspicious_id string, source_reference string")
    m = detection_metrics(res, truth).first()
    assert (m.precision, m.recall, m.f1_score, m.true_positives, m.false_negatives) == (0.0, 0.0, 0.0, 0, 0)
    pairs = spark.createDataFrame([], "suspicious_id string, source_id string")
    matches, summary = compare_chunked(only_src, pairs)
    assert matches.count() == 0 and summary.count() == 0
