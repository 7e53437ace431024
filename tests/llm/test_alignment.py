"""Alignment against a plain statement of it on the libraries' own ids."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from palimpsest.llm import alignment, q_alignment

A, B = P.path(q_alignment.TOKENIZER_A), P.path(q_alignment.TOKENIZER_B)


def tokens_of(text):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = alignment._byte_of()
    a = [(i, bytes(byte_of[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    want = (" " + text).encode()
    if not text or any(b"".join(x for _, x in side) != want for side in (a, b)):
        return [], []
    return a, b


def plain(texts):
    per, counts = [], Counter()
    for text in texts:
        a, b = tokens_of(text or "")
        ends, groups, links = {}, [], []
        for side, toks in enumerate((a, b)):
            at = 0
            for i, x in toks:
                at += len(x)
                ends.setdefault(at, [None, None])[side] = i
        cuts = sorted(e for e, (x, y) in ends.items() if x is not None and y is not None)
        at, lists = 0, [[], []]
        for side, toks in enumerate((a, b)):
            at, now = 0, []
            for i, x in toks:
                at += len(x)
                now.append(i)
                if at in cuts:
                    lists[side].append(now)
                    now = []
        groups = list(zip(*lists))
        links = [tuple(ends[c]) for c in cuts]
        counts.update(links)
        per.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    line = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [(n_a, n_b, len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(line(g).encode()).hexdigest() if g else "") for n_a, n_b, g, links in per]


def rows(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


@pytest.mark.parametrize("head_pairs", [1_000_000, 40, 0])
def test_like_the_plain_statement(spark, awkward, head_pairs):
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    want = sorted(((i is None, i or 0), row) for (i, _), row in zip(docs, plain([t for _, t in docs])))
    assert rows(alignment.link_summary(awkward, A, B, head_pairs=head_pairs)) == want


def test_texts_a_tokenizer_changes_have_no_tokens(spark, make):
    got = rows(alignment.link_summary(make([(1, "a ▁ b"), (2, None), (3, ""), (4, "plain")]), A, B))
    assert [g[1] for g in got[:3]] == [(0, 0, 0, 0, 0, 0, "")] * 3 and got[3][1][0] > 0


def test_empty_table(spark, empty):
    df = alignment.link_summary(empty, A, B)
    assert df.collect() == [] and df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert alignment.align(empty, A, B).collect() == []


def test_groups_hold_the_same_bytes(spark, awkward):
    bytes_a, bytes_b = alignment.load_a(A)[1], alignment.load_b(B)[1]
    for r in alignment.align(awkward, A, B).collect():
        cut = lambda ids, groups, spelt: [b"".join(spelt[i] for i, g in zip(ids, groups) if g == k) for k in range(len(r.group_end))]
        if len(r.a_ids) > 2000:
            continue
        a, b = cut(r.a_ids, r.a_group, bytes_a), cut(r.b_ids, r.b_group, bytes_b)
        assert a == b and np.cumsum([len(x) for x in a]).tolist() == list(r.group_end)


def test_pointer_jumping_on_random_cuts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 5000):
        for share in (0.02, 0.5):
            a, b = (np.append(np.flatnonzero(rng.random(n - 1) < share) + 1, n) for _ in range(2))
            ga, gb = alignment.group_labels(a, b)
            common = np.intersect1d(a, b)
            assert ga.tolist() == np.searchsorted(common, a).tolist() and gb.tolist() == np.searchsorted(common, b).tolist()


def test_a_chain_as_long_as_the_text():
    n = 4096  # ends never meet before the last byte
    a, b = np.append(np.arange(1, n, 2), n), np.append(np.arange(2, n, 2), n)
    ga, gb = alignment.group_labels(a, b)
    assert set(ga.tolist()) == set(gb.tolist()) == {0}


def test_counts_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(alignment, "MAX_HELD", 50)
    held, total, rng = alignment.Held(), Counter(), np.random.default_rng(2)
    want = Counter()
    for _ in range(60):
        codes = np.unique(rng.integers(500, size=30))
        times = rng.integers(1, 5, size=len(codes))
        want.update(dict(zip(codes.tolist(), times.tolist())))
        if held.add(codes, times):
            for c, t in zip(*held.taken()):
                total[int(c)] += int(t)
    for c, t in zip(*held.taken()):
        total[int(c)] += int(t)
    assert total == want
