import itertools
import random

import re

import pytest

from palimpsest.operators.bestmatch import best_matches
from palimpsest.operators.simjoin import cosine_pairs
from palimpsest.operators.truth import attach_truth, detection_metrics
from palimpsest.plans.corpus import corpus_counts, detect_reuse
from palimpsest.sources.tables import passage_containment, passage_documents

from tests import pyref

WORDS = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega rho tau".split()


def _docs(n, seed, length=30):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, length))) for _ in range(n)]


def _corpus(spark, src, sus):
    rows = [(f"s{i}", "source", t) for i, t in enumerate(src)]
    rows += [(f"u{i}", "suspicious", t) for i, t in enumerate(sus)]
    return spark.createDataFrame(rows, "id string, type string, raw_text string")


def _expected(src, sus, threshold):
    src_terms = [pyref.terms(pyref.tokens(t)) for t in src]
    sus_terms = [pyref.terms(pyref.tokens(t)) for t in sus]
    ws, wu = pyref.tfidf(src_terms, src_terms), pyref.tfidf(src_terms, sus_terms)
    out = {}
    for (i, a), (j, b) in itertools.product(enumerate(wu), enumerate(ws)):
        sim = pyref.cosine(a, b)
        if sim >= threshold:
            out[(f"u{i}", f"s{j}")] = sim
    return out


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle", "prefix"])
def test_detect_reuse_matches_brute_force(spark, strategy):
    src, sus = _docs(12, 1), _docs(15, 2) + ["", "a the"]
    sus[3] = src[4]  # a verbatim copy
    res = detect_reuse(_corpus(spark, src, sus), threshold=0.3, strategy=strategy, prep={"stem": False}).collect()
    got = {(r.suspicious_id, r.source_id): r.similarity_score for r in res}
    exp = _expected(src, sus, 0.3)
    assert got.keys() == exp.keys()
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
    assert got[("u3", "s4")] == pytest.approx(1.0)


def test_salted_join_equals_plain_join(spark):
    rows_s = [(f"u{i}", t, 1.0) for i in range(40) for t in ("hot", f"r{i % 7}")]
    rows_r = [(f"s{j}", t, 0.5) for j in range(30) for t in ("hot", f"r{j % 5}")]
    sus = spark.createDataFrame(rows_s, "sus string, term string, w double")
    src = spark.createDataFrame(rows_r, "src string, term string, w double")
    plain = cosine_pairs(sus, src, sus_key="sus", src_key="src", strategy="broadcast").collect()
    salted = cosine_pairs(sus, src, sus_key="sus", src_key="src", strategy="shuffle",
                          rows_per_salt=4).collect()
    assert sorted(plain) == sorted(salted)
    assert len(plain) == 40 * 30


def test_non_positive_threshold_refused(spark):
    df = spark.createDataFrame([("a", "t", 1.0)], "k string, term string, w double")
    with pytest.raises(ValueError):
        cosine_pairs(df, df.withColumnRenamed("k", "j"), sus_key="k", src_key="j", threshold=0)


def test_best_match_ties_and_defaults(spark):
    sims = spark.createDataFrame([("p", 0, 2, 0.5), ("p", 0, 1, 0.5), ("p", 1, 3, 0.2)],
                                 "g string, s int, r int, similarity double")
    sus = spark.createDataFrame([("p", 0), ("p", 1), ("p", 2), ("q", 0)], "g string, s int")
    src = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3)], "g string, r int")
    out = {(r.g, r.s): (r.r, r.similarity) for r in
           best_matches(sims, sus, src, group=["g"], sus_idx="s", src_idx="r").collect()}
    assert out == {("p", 0): (1, 0.5), ("p", 1): (3, 0.2), ("p", 2): (1, 0.0)}


def test_truth_first_in_order_and_substring_quirk(spark):
    matches = spark.createDataFrame([("x", "doc1", 0.9), ("x", "doc2", 0.8), ("y", "doc1", 0.7)],
                                    "suspicious_id string, source_id string, similarity_score double")
    truth = spark.createDataFrame([("x", 1, "doc10.txt"), ("x", 0, "doc1.txt"), ("x", 2, "doc2.txt")],
                                  "suspicious_id string, ordinal int, source_reference string")
    got = {(r.suspicious_id, r.source_id): (r.ground_truth, r.source_reference)
           for r in attach_truth(matches, truth).collect()}
    assert got == {("x", "doc1"): (True, "doc1.txt"), ("x", "doc2"): (True, "doc2.txt"),
                   ("y", "doc1"): (False, "")}
    truth2 = spark.createDataFrame([("x", 0, "doc10.txt")], "suspicious_id string, ordinal int, source_reference string")
    contains = attach_truth(matches, truth2).filter("source_id = 'doc1' AND suspicious_id = 'x'").first()
    exact = attach_truth(matches, truth2, match="exact").filter("source_id = 'doc1' AND suspicious_id = 'x'").first()
    assert contains.ground_truth and not exact.ground_truth


def test_metrics_formula_and_empty(spark):
    res = spark.createDataFrame([("x", "a", True, "a.txt"), ("x", "b", True, "a.txt"),
                                 ("y", "c", False, "")],
                                "suspicious_id string, source_id string, ground_truth boolean, source_reference string")
    truth = spark.createDataFrame([("x", "a.txt"), ("z", "q.txt")],
                                  "suspicious_id string, source_reference string")
    m = detection_metrics(res, truth).first()
    assert (m.true_positives, m.false_positives, m.false_negatives, m.false_negatives_strict) == (2, 1, 0, 1)
    assert m.precision == pytest.approx(2 / 3) and m.recall == pytest.approx(1.0)
    assert m.f1_score == pytest.approx(0.8)
    empty = detection_metrics(res.limit(0), truth).first()
    assert (empty.precision, empty.recall, empty.f1_score, empty.false_negatives) == (0.0, 0.0, 0.0, 2)


def test_passage_containment_brute_force(spark):
    docs = ["xx Alpha beta gamma delta eps. tail", "Alpha beta gamma", "one two three four",
            "prefixAlpha beta gamma delta eps.", "  hello world  again", "abc"]
    passages = ["Alpha beta gamma delta eps.", "two three", "hello world  again", "b", "zzz qq yy ww vv"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.offset, r.length) for r in passage_containment(d, p).collect()}
    exp = {(i, j): (dt.find(pt), len(pt)) for i, dt in enumerate(docs)
           for j, pt in enumerate(passages) if pt in dt}
    assert got == exp


def test_containment_of_short_passages(spark):
    """One and two words, odd whitespace and parts of tokens, on generated texts, against ``in``."""
    rnd = random.Random(11)
    words, gaps = ["a", "ab", "ba", "the", "hethe", "é", "b.", "(the"], [" ", "  ", "\n", " \t"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(n))
    docs = [text(rnd.randint(0, 12)).strip(rnd.choice([" ", "\n", "x"])) for _ in range(60)] + [None, "", "  "]
    passages = sorted({text(n)[rnd.randint(0, 2):][:-1] for n in (1, 2, 2, 2, 3, 4) for _ in range(25)} | {"", " ", "a ", " a", "the a", "e\n"})
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    exp = {(i, j) for i, dt in enumerate(docs) for j, pt in enumerate(passages) if pt.strip() and pt in (dt or "")}
    got = [(r.doc_id, r.item_id) for r in passage_documents(d, p).collect()]
    assert len(got) == len(set(got)) and set(got) == exp and len(exp) > 200
    places = {(r.doc_id, r.item_id): r.offset for r in passage_containment(d, p).collect()}
    assert places == {(i, j): docs[i].find(passages[j]) for i, j in exp}
    assert passage_documents(d, p.limit(0)).count() == 0 and passage_documents(d.limit(0), p).count() == 0


def test_two_word_passages_need_no_text(spark):
    """Pairs of words are found by equality: their plan has neither ``contains`` nor a nested loop."""
    d = spark.createDataFrame([(1, "of the people")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "of the")], "item_id long, text string")
    from palimpsest.sources.tables import _contained
    sure, _, _ = _contained(d, p, "doc_id", "text", "item_id", "text")
    plan = sure._jdf.queryExecution().toString()
    assert "Contains" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan and sure.count() == 1


def test_two_word_passages_are_looked_up_in_place(spark, monkeypatch):
    """Neither tokens nor pairs of them move or are joined, only pairs that hold do; more passages go by joins, with the same rows."""
    from palimpsest.sources import tables
    rnd = random.Random(5)
    words, gaps = ["a", "aa", "ba", "ab", "é\U00010400", "a.b"], [" ", "  ", "\u00a0", "\x1c", "\u2003\n"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(n))
    docs = [("d%d" % (i % 40), text(rnd.randint(0, 9)).strip(rnd.choice(["a", " "]))) for i in range(80)] + [("n", None), (None, "a a")]
    passages = [(i, rnd.choice(words) + rnd.choice(gaps) + rnd.choice(words)) for i in range(60)] + [(None, "a a"), (70, "a a"), (71, "a a")]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    p = spark.createDataFrame(passages, "item_id int, text string")
    exp = {(i, j) for i, dt in docs for j, pt in passages if pt in (dt or "")}
    sure, open_, _ = tables._contained(d, p, "doc_id", "text", "item_id", "text")
    plan = sure._jdf.queryExecution().toString()
    assert open_ is None and "Join" not in plan and "Generate" not in plan
    for limit in (tables._MAX_LOOKED_UP, 0):
        monkeypatch.setattr(tables, "_MAX_LOOKED_UP", limit)
        got = [tuple(r) for r in passage_documents(d, p).collect()]
        assert len(got) == len(set(got)) and set(got) == exp and len(exp) > 50
    monkeypatch.setattr(tables, "_MAX_KEPT", 2)
    kept = tables._Kept(len)
    assert [kept[x] for x in ("a", "bb", "ccc", "bb", "a")] == [1, 2, 3, 2, 1] and len(kept) <= 2


def test_corpus_counts(spark):
    corpus = _corpus(spark, ["alpha beta"], ["alpha beta", "zeta"])
    res = detect_reuse(corpus, prep={"stem": False})
    c = corpus_counts(corpus, res).first()
    assert (c.documents, c.source_documents, c.suspicious_documents, c.matches) == (3, 1, 2, 1)


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.6, 0.95])
def test_prefix_filter_equals_plain_join(spark, threshold):
    rnd = random.Random(threshold)
    def vectors(prefix, n):
        rows = []
        for i in range(n):
            terms = {"hot": rnd.random() * 3, "warm%d" % rnd.randint(0, 2): rnd.random()}
            for _ in range(rnd.randint(0, 6)):
                terms["r%d" % rnd.randint(0, 30)] = rnd.random()
            norm = sum(v * v for v in terms.values()) ** 0.5
            rows += [(f"{prefix}{i}", t, v / norm) for t, v in terms.items()]
        return rows
    sus = spark.createDataFrame(vectors("u", 40), "sus string, term string, w double")
    src = spark.createDataFrame(vectors("s", 30), "src string, term string, w double")
    plain = {(r.sus, r.src): r.similarity for r in cosine_pairs(
        sus, src, sus_key="sus", src_key="src", threshold=threshold, strategy="broadcast").collect()}
    pref = {(r.sus, r.src): r.similarity for r in cosine_pairs(
        sus, src, sus_key="sus", src_key="src", threshold=threshold, strategy="prefix",
        rows_per_salt=5).collect()}
    assert plain.keys() == pref.keys() and len(plain) > 0
    for k in plain:
        assert pref[k] == pytest.approx(plain[k], abs=1e-12)


def _executed_plan(df):
    import contextlib
    import io

    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_flagship_plan_moves_no_text(spark):
    """With broadcastable sources only in-vocabulary term counts are shuffled (by id and term,
    then by id); no exchange carries a text, and every join is a broadcast."""
    src, sus = _docs(10, 5), _docs(30, 6)
    corpus = _corpus(spark, src, sus).repartition(2 * spark.sparkContext.defaultParallelism).checkpoint()
    plan = _executed_plan(detect_reuse(corpus, prep={"stem": False}))
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final
    details = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", plan)
    assert details and not any(re.search(r"text|tokens|terms|metadata", d) for d in details), details
