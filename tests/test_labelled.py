"""The labelled corpus as a data source, against plain statements of its rules."""

import hashlib
import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.sources.corpus import BASE, SIDES, load_corpus
from palimpsest.sources.labelled import LabelledReader, read_labelled, sample_bounds, sidecar_metadata

UNKNOWN = {"authors": None, "title": None, "language": "unknown", "plagiarism": None}


def note(offset="0", reference="source-document00001.txt"):
    return f'<feature name="plagiarism" source_reference="{reference}" this_offset="{offset}" this_length="7"/>'


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("labelled")
    for side, folder in SIDES.items():
        for i in range(30):
            part = base / BASE / folder / f"part{1 + i % 3}"
            part.mkdir(parents=True, exist_ok=True)
            (part / f"{folder}{i:05d}.txt").write_bytes(f"Text {i}\r\nof {side}\r".encode() + b"\xff\xc3" * (i % 2))
            if i % 4 == 0:
                (part / f"{folder}{i:05d}.xml").write_text(f"<document>{note(str(i))}</document>")
    (base / BASE / "source-document" / "part9").mkdir()
    (base / BASE / "source-document" / "part1" / "readme.md").write_text("no text of the corpus")
    return str(base)


@pytest.mark.parametrize("content, want", [
    ("<d/>", None), ("<d><x/><feature name='other'/></d>", None), ("", UNKNOWN), ("no markup", UNKNOWN),
    ("<d><feature name='about'", UNKNOWN), (f"<d>{note()}</d><d>{note()}</d>", UNKNOWN),  # the same root twice
    (f"<d>{note('1.5')}</d>", UNKNOWN), (f"<d>{note(str(2**31))}</d>", UNKNOWN), (f"<d>{note()}{note('x')}</d>", UNKNOWN),
    ("<feature name='about' lang='en'/>", None),  # the root itself is no feature
    ("<?xml version='1.0' encoding='no-such'?><d/>", UNKNOWN),
    ("<d><feature name='about' lang='en'/><x><feature name='about' title='T'/></x></d>",
     {"authors": "unknown", "title": "T", "language": "unknown", "plagiarism": None})])
def test_sidecars(content, want):
    assert sidecar_metadata(content.encode()) == want


def test_annotations_keep_their_order():
    notes = "".join(f"<x>{note(str(o))}</x>" if o % 2 else note(str(o)) for o in (5, 3, 9, 1, 3))
    got = sidecar_metadata(f"<d>{notes}<feature name='plagiarism'/></d>".encode())
    assert [a["offset"] for a in got["plagiarism"]] == [5, 3, 9, 1, 3, -1] and got["language"] is None
    assert got["plagiarism"][-1] == {"source_reference": "", "offset": -1, "length": 0, "type": "unknown", "obfuscation": "none"}


def test_rows_equal_the_other_reader(spark, root):
    both = [load_corpus(spark, root, prepare=False, reader=r, max_src=n, max_sus=m)
            for n, m in ((None, None), (13, 4), (0, 100)) for r in ("source", "jvm")]
    rows = [Counter(str(r) for r in df.collect()) for df in both]
    assert rows[0] == rows[1] and rows[2] == rows[3] and rows[4] == rows[5]
    assert [sum(r.values()) for r in rows[::2]] == [60, 17, 30]
    assert r"Text 1\nof source\n'" in "".join(rows[0])


def test_a_partition_per_part_and_filters(spark, root):
    whole = read_labelled(spark, root)
    assert whole.rdd.getNumPartitions() == 7  # part9 is empty
    one = whole.where("part = 'part2' AND type = 'source' AND length(raw_text) > 0")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 10
    assert whole.where(F.col("part").isin("part1", "part3")).count() == 40
    assert whole.where("part = 'none'").count() == 0
    with pytest.raises(Exception, match="no side of a labelled corpus"):
        read_labelled(spark, os.path.join(root, "missing")).count()


def test_order_is_stable(spark, root):
    by_part = lambda: [r.id for r in read_labelled(spark, root, side="source").collect()]
    ids = by_part()
    assert ids == by_part() == sorted(ids, key=lambda i: (int(i[-5:]) % 3, i))


def test_files_outside_the_sample_are_not_opened(spark, root, monkeypatch):
    bounds = sample_bounds(spark, root, {"source": 13, "suspicious": None})
    opened = []
    reader = LabelledReader({"path": root, "side": "source", "bounds": json.dumps(bounds)})
    monkeypatch.setattr(LabelledReader, "bytes_of", staticmethod(lambda files, path: opened.append(path) or b"<d/>"))
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    key = lambda i: (f"part{1 + i % 3}", hashlib.md5(f"42|source-document{i:05d}".encode()).hexdigest())
    want = {f"source-document{i:05d}" for i in sorted(range(30), key=key)[:13]}
    assert {r["id"] for r in rows} == want and len(rows) == 13
    names = {os.path.basename(p) for p in opened}
    assert {n[:-4] for n in names} == want and not any("part3" in p for p in opened)
    assert {n[:-4] for n in names if n.endswith(".xml")} == {w for w in want if int(w[-5:]) % 4 == 0}
