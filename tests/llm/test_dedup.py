"""Operators 1, 6 and 7 against plain statements."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import components, exact_dedup, repeats, simhash
from palimpsest.llm.suffix_groups import suffix_array
from tests.llm import brute
from tests.llm.conftest import awkward_texts


def collected(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
REPEAT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_exact(awkward):
    assert collected(exact_dedup.exact_dedup(awkward), *EXACT) == brute.exact(awkward_texts())


def test_exact_with_clashing_chunk_hashes(awkward):
    # a hash of few values: recipes must be told apart by the chunk texts
    poor = lambda c: F.xxhash64(c) % 3
    assert collected(exact_dedup.exact_dedup(awkward, chunk_hash=poor), *EXACT) == brute.exact(awkward_texts())


def test_chunks_are_the_text(awkward):
    t = F.coalesce("text", F.lit(""))
    bad = awkward.where(F.array_join(exact_dedup.chunk_texts(t), "") != t)
    assert bad.count() == 0


def test_drop_copies(awkward):
    got = exact_dedup.drop_copies(awkward)
    assert got.columns == awkward.columns
    assert Counter((r.doc_id, brute.norm(r.text)) for r in got.collect()) == Counter(
        (k, t) for t, k in {brute.norm(t): max((k for k, u in awkward_texts() if brute.norm(u) == brute.norm(t)), key=brute.KEY)
                            for _, t in awkward_texts()}.items())


def test_simhash(awkward):
    got = collected(simhash.simhash_dedup(awkward), "doc_id", "fingerprint", "component_id")
    assert got == Counter(brute.simhash(awkward_texts()))


def test_drop_near_copies(awkward):
    got = simhash.drop_near_copies(awkward)
    assert got.columns == awkward.columns
    stay = brute.first_of_classes(awkward_texts())
    assert collected(got, "doc_id", "text") == Counter((k, t) for k, t in awkward_texts() if (k, t or "") in stay)


def test_one_near_copy_stays_whatever_the_keys(make):
    """Null keys, and near copies under one key."""
    base = " ".join(f"w{i}" for i in range(400))
    near = [base + f" tail{i}" for i in range(6)]
    prints = {brute.fingerprint(t) for t in near}
    assert all(any((a ^ b).bit_count() <= 2 for b in prints if b != a) or len(prints) == 1 for a in prints)
    for keys in ([None] * 6, [5] * 6, [None, 5, 5, 6, None, 9]):
        pairs = list(zip(keys, near))
        stay = brute.first_of_classes(pairs)
        got = collected(simhash.drop_near_copies(make(pairs)), "doc_id", "text")
        assert got == Counter(stay) and len(stay) == len(set(brute.classes([brute.fingerprint(t) for t in near])))


@pytest.mark.parametrize("group", [4096, 8])
def test_links_of_codes(spark, monkeypatch, group):
    """Random clusters of codes, also with groups so small that many are split."""
    monkeypatch.setattr(simhash, "MAX_GROUP", group)
    rng = random.Random(3)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for c in list(codes)[:12]:
        for _ in range(12):
            for _ in range(rng.randint(1, 3)):
                c ^= 1 << rng.randrange(64)
            codes.add(c)
    codes = sorted(codes)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    members = simhash._members(spark.createDataFrame(signed, "fp long"), 3)
    ranked = members.withColumn("rank", simhash.gray_rank(F.col("fp"))).repartition("mask", "value").sortWithinPartitions(
        "mask", "value", "rank").select("mask", "value", "fp")
    roots = components.connected_components(simhash.map_batches(ranked, simhash._links(2), "a long, b long"))
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in roots.collect()}
    want = brute.classes(codes)
    got = [found.get(c, c) for c in codes]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    edges += [(1000, 1001 + i) for i in range(200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: r for n, r in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_suffix_array():
    rng = random.Random(2)
    for alphabet in (b"ab", b"abc\x00", bytes(range(256))):
        for n in (0, 1, 2, 7, 30, 200):
            text = bytes(rng.choice(alphabet) for _ in range(n))
            assert list(suffix_array(text)) == sorted(range(n), key=lambda i: text[i:])
    assert list(suffix_array(b"a" * 5000)) == list(range(4999, -1, -1))


def expected_repeats(pairs):
    return Counter(brute.repeat_row(k, raw, gone) for (k, _), (raw, gone) in zip(pairs, brute.repeats(pairs)))


@pytest.mark.parametrize("limit", [4 << 20, 300])
def test_repeats(awkward, monkeypatch, limit):
    """Also with a limit so small that minimisers with several cuts go string by string."""
    monkeypatch.setattr(repeats, "MAX_BYTES", limit)
    assert collected(repeats.remove_repeats(awkward), *REPEAT) == expected_repeats(awkward_texts())


def test_repeats_across_blocks(make, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 64)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(333))
    pairs = [(i, "".join(rng.choice("xyz ") for _ in range(i * 37)) + passage[i:] + "q" * 250) for i in range(6)]
    found = [repeats.cuts(t.encode(), 100) for _, t in pairs]
    assert all((s[1:] == (s + n)[:-1]).all() for s, n, _, _ in found)
    monkeypatch.undo()
    assert collected(repeats.remove_repeats(make(pairs)), *REPEAT) == expected_repeats(pairs)


def test_cut_repeats(awkward):
    got = repeats.cut_repeats(awkward)
    assert got.columns == awkward.columns
    want = Counter()
    for (k, _), (raw, gone) in zip(awkward_texts(), brute.repeats(awkward_texts())):
        want[k, bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore")] += 1
    assert collected(got, "doc_id", "text") == want
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_repeats_in_rows_numbered_high(spark):
    """A row's number among those of its key may take any value."""
    rng = random.Random(21)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    differing = [passage[:250] + "".join(rng.choice("xyz ") for _ in range(60 + i)) + passage for i in range(3)]
    for texts in ([passage] * 6, [*differing, passage, "q" * 400, "q" * 300]):
        numbers = [0, 1, 1 << 19, (1 << 20) + 1, 1 << 40, (1 << 62) + 5]
        rows = spark.createDataFrame([(None if i % 2 else 7, o, t) for i, (o, t) in enumerate(zip(numbers, texts))],
                                     "k long, o long, t string")
        got = Counter()
        for r in repeats._marked(rows, 100).collect():
            raw, _, kept = repeats._remaining(r.t, r.runs, 100)
            got[r.k, r.o, len(raw) - len(kept)] += 1
        order = sorted(((None if i % 2 else 7, o, t) for i, (o, t) in enumerate(zip(numbers, texts))),
                       key=lambda r: (r[0] is not None, r[1]))
        gone = brute.repeats([(i, t) for i, (_, _, t) in enumerate(order)])
        assert got == Counter((k, o, sum(g)) for (k, o, _), (_, g) in zip(order, gone))


def test_rows_of_one_key_are_numbered_in_many_tasks(make, monkeypatch):
    monkeypatch.setattr(repeats, "COPIES", 50)
    rng = random.Random(22)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(600)] + [None] * 200 + ["z" * 300] * 200
    texts += ["y" * 300 + str(i) for i in range(40)]
    docs = make([(None if i % 2 else 5, t) for i, t in enumerate(texts)] + [(9, "alone")])
    got = repeats.numbered(docs, "doc_id", "text")
    for k in (None, 5):
        mine = sorted((r.o, r.t) for r in got.collect() if r.k == k)
        assert [o for o, _ in mine] == list(range(len(mine)))
        assert [t for _, t in mine] == sorted(t or "" for i, t in enumerate(texts) if (None if i % 2 else 5) == k)
    assert [r.o for r in got.where("k = 9").collect()] == [0]
    tasks = got.where("k = 5").select(F.input_file_name().alias("f")).distinct().count()
    assert tasks > 3


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert simhash.simhash_dedup(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert repeats.cut_repeats(empty).columns == empty.columns
