"""Operators 2, 4 and 5 against the libraries and exact laws."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from palimpsest.llm import packing, sampling, token_counts
from tests.llm.conftest import awkward_texts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def noise(seed, n, size=9):
    rng = random.Random(seed)
    parts = [" ", "  ", "a", "the", "▁", "\n", "\t", "12", "<s>", "é", "漢", "</s>", "😀", "\x00", "½", "²", "².", "_", "ا", "ि", "क", ".", "!!",
             "'s", "<|endoftext|>", "‍", " ", "　"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_encoder_is_the_library():
    encode, whole = packing.load_encoder(BPE), Tokenizer.from_file(BPE)
    texts = noise(1, 4000) + [t for _, t in awkward_texts() if t] + [" " * 150_000 + "x", "\n" * 120_000]
    for t in texts:
        assert encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_piece_lengths():
    for n in range(1, 5000, 7):
        lengths = packing.piece_lengths(n, 2048)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 2048 for x in lengths) and lengths == sorted(lengths)[::-1]


def test_pack(awkward):
    whole = Tokenizer.from_file(BPE)
    rows = packing.pack(awkward, BPE, with_ids=True).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_id = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in rows), reverse=True)
    assert all(r.offset == 0 and len(r.ids) == r.length and r.length & (r.length - 1) == 0 for r in rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    want = Counter()
    for k, t in awkward_texts():
        ids, at = whole.encode(t or "", add_special_tokens=False).ids + [1], 0
        for n in packing.piece_lengths(len(ids), 2048):
            want[k, at, tuple(ids[at:at + n]), len(ids)] += 1
            at += n
    assert Counter((r.doc_id, r.start, tuple(r.ids), r.doc_tokens) for r in rows) == want


def test_pre_tokens_add_up(library):
    token_counts.load_model(PIECES)
    for t in noise(2, 6000) + [t for _, t in awkward_texts() if t]:
        assert sum(token_counts.piece_counts(library, token_counts.pre_tokens(t))) == len(library.encode(t))


@pytest.mark.parametrize("head", [48 << 20, 2000, 0])
def test_token_counts(awkward, library, head):
    """With all, some and none of the pre-tokens broadcast."""
    got = token_counts.token_counts(awkward, PIECES, head_bytes=head)
    want = Counter((k, len((t or "").encode()), len(library.encode(t or ""))) for k, t in awkward_texts())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want


def all_segmentations(text, vocab):
    text, out = " " + text, []

    def walk(i, codes, weight):
        if i == len(text):
            out.append((tuple(codes), weight))
            return
        for j in range(i + 1, min(len(text), i + sampling.MAX_PIECE) + 1):
            code = vocab.ids.get(text[i:j])
            if code is not None:
                walk(j, codes + [code], weight * vocab.weight[code])
            elif j == i + 1:
                walk(j, codes + [-2 - ord(text[i])], weight * vocab.byte_weight ** len(text[i].encode()))

    walk(0, [], 1.0)
    total = sum(w for _, w in out)
    return {c: w / total for c, w in out}


@pytest.mark.parametrize("text", ["the cat", "ab漢 x"])
def test_sampling_law(text):
    """First and second draws have the law of sampling without replacement, and the
    inclusion scores make unbiased estimates."""
    vocab, n = sampling.vocabulary(PIECES, 0.6), 4000
    law = all_segmentations(text, vocab)
    first, second, estimate = Counter(), Counter(), defaultdict(float)
    for draws in sampling.sample_rows([text] * n, list(range(n)), vocab, 2, 1):
        codes = [tuple(d[0].tolist()) for d in draws]
        assert len(set(codes)) == len(codes) == 2 and draws[0][2] >= draws[1][2]
        assert all(math.isclose(math.log(law[c]), d[1], abs_tol=1e-6) for c, d in zip(codes, draws))
        first[codes[0]] += 1
        second[codes[1]] += 1
        for c, d in zip(codes, draws):
            estimate[c] += law[c] / math.exp(d[3]) / n
    for c, p in sorted(law.items(), key=lambda x: -x[1])[:4]:
        q = sum(x * p / (1 - x) for a, x in law.items() if a != c)
        assert abs(first[c] / n - p) < 5 * math.sqrt(p / n) + 1e-3
        assert abs(second[c] / n - q) < 5 * math.sqrt(q / n) + 1e-3
        assert abs(estimate[c] - p) < 0.05 * p + 0.01


@pytest.mark.parametrize("alpha", [0.6, 6.0, 9.0])
@pytest.mark.parametrize("text", ["the cats", "a\nb cd", "ab漢 x"])
def test_sampling_gives_all(text, alpha):
    """A ``k`` beyond the number of segmentations gives each of them once, also those rarer than any tail."""
    vocab = sampling.vocabulary(PIECES, alpha)
    law = all_segmentations(text, vocab)
    draws, = sampling.sample_rows([text], [7], vocab, len(law) + 5, 1)
    assert Counter(tuple(d[0].tolist()) for d in draws) == Counter(law.keys())
    assert [d[2] for d in draws] == sorted((d[2] for d in draws), reverse=True)
    assert alpha < 1 or min(d[1] for d in draws) < sampling.TAIL


def test_sampling_law_behind_the_tail(monkeypatch):
    """The law holds where choices wait together and are opened later."""
    monkeypatch.setattr(sampling, "TAIL", -0.5)
    test_sampling_law("the cat")


def test_samples(awkward):
    rows = sampling.sample_segmentations(awkward, PIECES, k=3, with_ids=True).collect()
    vocab = sampling.vocabulary(PIECES, 0.6)
    texts = defaultdict(set)
    for k, t in awkward_texts():
        texts[k].add((t or "").replace("▁", " "))
    by_row = defaultdict(list)
    for r in rows:
        assert r.decodes and vocab.decode(r.ids) in texts[r.doc_id]
        by_row[r.doc_id, vocab.decode(r.ids)].append(r)
    assert len(by_row) == len({(k, (t or "").replace("▁", " ")) for k, t in awkward_texts()})
    for rs in by_row.values():
        draws = {r.draw: tuple(r.ids) for r in rs}
        assert len(set(draws.values())) == len(draws)
    again = sampling.sample_segmentations(awkward.repartition(2), PIECES, k=3).collect()
    assert Counter((r.doc_id, r.draw, r.ids_crc32) for r in again) == Counter((r.doc_id, r.draw, r.ids_crc32) for r in rows)


def test_decode(spark, awkward, empty):
    """What is encoded comes back, for drawn segmentations and for the library's own."""
    drawn = sampling.sample_segmentations(awkward, PIECES, k=1, with_ids=True).select("doc_id", "ids")
    got = Counter((r.doc_id, r.text) for r in sampling.decode_ids(drawn, PIECES).collect())
    assert got == Counter((k, (t or "").replace("▁", " ")) for k, t in awkward_texts())
    lib = token_counts.load_model(PIECES)
    plain = [(str(i), lib.encode(t), t) for i, t in enumerate(["the cat", "漢字 x1", "a\nb", ""])]
    odd = [(None, None, None), ("e", [], ""), ("u", [lib.unk_id(), -1, None, 10**9, 2**40], "\ufffd" * 5), ("c", [1, 2], ""),
           ("b", [lib.piece_to_id("<0xE6>")], "\ufffd"), ("b", [lib.piece_to_id("<0x41>")], "A")]
    table = spark.createDataFrame(plain + odd + odd[:1], "name string, codes array<long>, text string")
    got = sampling.decode_ids(table, PIECES, "name", "codes").collect()
    assert Counter((r.name, r.text) for r in got) == Counter((n, t) for n, _, t in plain + odd + odd[:1])
    assert sampling.decode_ids(table.limit(0), PIECES, "name", "codes").count() == 0


def test_empty(empty):
    assert packing.pack(empty, BPE).count() == 0
    assert token_counts.token_counts(empty, PIECES).count() == 0
    assert sampling.sample_segmentations(empty, PIECES).count() == 0
