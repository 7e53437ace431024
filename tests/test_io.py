import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.truth import loaded_truth
from palimpsest.plans.corpus import detect_reuse
from palimpsest.plans.jobs import run_corpus_job, run_pair_job
from palimpsest.sources.corpus import load_corpus
from palimpsest.sources.sinks import read_chunk_report, write_chunk_report
from palimpsest.streaming.incremental import SourceIndex, start_detection_stream

BASE = "external-detection-corpus"

SRC = {
    "source-document00001": "Lanterns glowed over the quiet canal while bakers carried warm loaves.",
    "source-document00002": "Mountain goats climb steep ridges searching for salt and sparse grass.",
    "source-document00010": "Clockmakers repair tiny gears with patient hands and bright lamps.",
}
SUS = {
    "suspicious-document00001": ("Lanterns glowed over the quiet canal while bakers carried warm loaves.",
                                 '<document><feature name="about" lang="en" authors="A" title="T"/>'
                                 '<x><feature name="plagiarism" source_reference="source-document00001.txt"'
                                 ' this_offset="0" this_length="70"/></x></document>'),
    "suspicious-document00002": ("Clockmakers repair tiny gears with patient hands and bright lamps!",
                                 '<document><feature name="plagiarism" source_reference="source-document00010.txt"'
                                 ' this_offset="x" this_length="5"/></document>'),
    "suspicious-document00003": ("Nothing in common here at all, only zebras.\r\n",
                                 "<document><feature name='about'"),
    "suspicious-document00004": ("Mountain goats climb steep ridges searching for salt.", None),
    "suspicious-document00005": ("Two roots in the sidecar.",
                                 '<?xml version="1.0"?><!-- c --><a><feature name="about" lang="en"/></a>'
                                 '<b><feature name="plagiarism" source_reference="x.txt"/></b>'),
}


@pytest.fixture(scope="module")
def corpus_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for side, docs in (("source-document", SRC), ("suspicious-document", SUS)):
        for i, (doc_id, val) in enumerate(sorted(docs.items())):
            part = root / BASE / side / f"part{1 + i % 2}"
            part.mkdir(parents=True, exist_ok=True)
            text, xml = (val, None) if isinstance(val, str) else val
            (part / f"{doc_id}.txt").write_bytes(text.encode("utf-8") + (b"\xff" if i == 1 else b""))
            if xml:
                (part / f"{doc_id}.xml").write_text(xml)
    (root / BASE / "source-document" / "notes").mkdir()
    (root / BASE / "source-document" / "notes" / "ignored.txt").write_text("not a part dir")
    return str(root)


@pytest.mark.parametrize("reader", ["source", "jvm"])
def test_load_corpus(spark, corpus_root, reader):
    df = load_corpus(spark, corpus_root, max_src=None, max_sus=None, reader=reader)
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == set(SRC) | set(SUS)
    d1 = rows["suspicious-document00001"]
    assert d1.metadata.language == "en" and d1.has_plagiarism
    assert d1.metadata.plagiarism[0].source_reference == "source-document00001.txt"
    d2 = rows["suspicious-document00002"]
    assert d2.metadata.language == "unknown" and d2.metadata.plagiarism is None and not d2.has_plagiarism
    assert not d2.raw_text.endswith("�")
    d3 = rows["suspicious-document00003"]
    assert d3.metadata.language == "unknown" and d3.raw_text.endswith("zebras.\n")
    assert rows["suspicious-document00004"].metadata is None
    d5 = rows["suspicious-document00005"]
    assert d5.metadata.language == "unknown" and not d5.has_plagiarism
    assert rows["source-document00001"].has_plagiarism is None
    capped = load_corpus(spark, corpus_root, max_src=1, max_sus=2, prepare=False, reader=reader)
    counts = {r.type: r["count"] for r in capped.groupBy("type").count().collect()}
    assert counts == {"source": 1, "suspicious": 2}


def test_corpus_job_writes_outputs(spark, corpus_root, tmp_path):
    out = run_corpus_job(spark, corpus_root, str(tmp_path), max_src=None, max_sus=None)
    m = {(r.suspicious_id, r.source_id): r for r in out["matches"].collect()}
    assert m[("suspicious-document00001", "source-document00001")].ground_truth
    assert not m[("suspicious-document00002", "source-document00010")].ground_truth
    lines = spark.read.text(str(tmp_path / "evaluation_metrics")).collect()
    assert [l.value.split(": ")[0] for l in lines] == [
        "precision", "recall", "f1_score", "true_positives", "false_positives", "false_negatives"]
    assert out["counts"].first().documents == 8


def test_truth_of_loaded_sources(spark):
    rows = [("u1", "a-1.txt"), ("u1", "part3/a-12.txt"), ("u2", "b.txt"), ("u2", None), ("u3", ""), ("u3", "a-1.txt"), ("u4", "漢b😀")]
    truth = spark.createDataFrame([(s, i, r) for i, (s, r) in enumerate(rows)], "suspicious_id string, ordinal int, source_reference string")
    for ids in (["a-1"], ["b", "zz"], [], [None, ""], ["a-12", "😀"], ["much longer than any reference"]):
        sources = spark.createDataFrame([(i,) for i in ids], "id string")
        for match, hit in (("contains", lambda r, i: i in r), ("exact", lambda r, i: r.replace(".txt", "") == i)):
            want = sorted((s, n) for n, (s, r) in enumerate(rows) if r is not None and any(i and hit(r, i) for i in ids))
            got = loaded_truth(truth, sources, match)
            assert got.columns == truth.columns and sorted((r.suspicious_id, r.ordinal) for r in got.collect()) == want


def test_metrics_of_a_sample_can_leave_unloaded_sources_out(spark, corpus_root, tmp_path):
    out = [run_corpus_job(spark, corpus_root, str(tmp_path / str(r)), max_src=0, restrict_to_loaded_sources=r)["metrics"].first()
           for r in (False, True)]
    assert [m.false_negatives for m in out] == [1, 0]


def test_chunk_report_by_pair(spark, tmp_path):
    """A pair is read from its bucket alone; a hot pair is in several files; nothing is lost."""
    rows = [("hot", "s", i, f"a, \"b\" {i}") for i in range(3000)] + [(f"u{i % 40}", f"s{i % 7}", i, "x") for i in range(400)]
    rows += [(None, "s1", 0, "null id")]
    fields = "suspicious_id string, source_id string, suspicious_chunk_idx int, suspicious_chunk_text string"
    path = str(tmp_path / "report")
    write_chunk_report(spark.createDataFrame(rows, fields), path, buckets=16, max_rows=500)
    everything = read_chunk_report(spark, path, schema=fields, buckets=16)
    assert sorted(map(tuple, everything.collect()), key=str) == sorted(rows, key=str)
    one = read_chunk_report(spark, path, [("hot", "s")], fields, 16)
    assert sorted(r.suspicious_chunk_idx for r in one.collect()) == list(range(3000))
    files = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert len(files) >= 6 and len({os.path.dirname(f) for f in files}) == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all(sum(1 for _ in open(f.removeprefix("file://"))) <= 501 for f in files)
    write_chunk_report(spark.createDataFrame([], fields), path)


def test_pair_jobs(spark, corpus_root, tmp_path):
    docs = load_corpus(spark, corpus_root, max_src=None, max_sus=None, prepare=False)
    pairs = spark.createDataFrame([("suspicious-document00001", "source-document00001")],
                                  "suspicious_id string, source_id string")
    for mode in ("tfidf", "dense"):
        out = run_pair_job(docs, pairs, str(tmp_path / mode), mode=mode)
        s = out["summary"].first()
        assert s.max_chunk_similarity == pytest.approx(1.0)
        assert os.listdir(tmp_path / mode / "chunk_similarities")


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s1", "source", SRC["source-document00001"]), ("s2", "source", SRC["source-document00002"])]
    rows += [(f"u{i}", "suspicious", t) for i, (t, _) in enumerate(
        v if isinstance(v, tuple) else (v, None) for v in SUS.values())]
    corpus = spark.createDataFrame(rows, "id string, type string, raw_text string")
    batch = {(r.suspicious_id, r.source_id): r.similarity_score
             for r in detect_reuse(corpus).collect()}
    inbox = tmp_path / "inbox"
    for i, part in enumerate((rows[2:4], rows[4:])):
        spark.createDataFrame([(a, c) for a, _, c in part], "id string, raw_text string") \
            .write.parquet(str(inbox / f"f{i}"))
    stream = (spark.readStream.schema("id string, raw_text string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(inbox)))
    index = SourceIndex(corpus.filter(F.col("type") == "source"))
    q = start_detection_stream(index, stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = {(r.suspicious_id, r.source_id): r.similarity_score
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == batch.keys() and len(got) > 0
    for k in got:
        assert got[k] == pytest.approx(batch[k])


def test_source_index_scores_with_truth(spark, corpus_root):
    docs = load_corpus(spark, corpus_root, max_src=None, max_sus=None, prepare=False)
    index = SourceIndex(docs.filter(F.col("type") == "source").select("id", "raw_text"))
    batch = docs.filter(F.col("type") == "suspicious").select("id", "raw_text", "metadata")
    got = {(r.suspicious_id, r.source_id): (r.ground_truth, r.source_reference)
           for r in index.score(batch).collect()}
    exp = {(r.suspicious_id, r.source_id): (r.ground_truth, r.source_reference)
           for r in detect_reuse(docs).collect()}
    assert got == exp and got[("suspicious-document00001", "source-document00001")][0]
