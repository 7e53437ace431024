"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the same bytes differently. Tokens of either that share bytes belong
together; the smallest such groups end where a token of both ends. Within a batch of documents:

1. every token points to the token that overlaps it and reaches farthest to the right: the token of
   the other side that holds its last byte, if that one ends later (found by binary search in
   the ends of tokens). A token of side A that ends together with one of B points to itself, its partner to it;
2. the pointers are doubled, ``to = to[to]`` for all tokens at once, until nothing changes: each chain then ends at the
   last token of its component, in as many rounds as the logarithm of the longest chain;
3. that terminal token is the label of the group. As documents do not overlap, all documents of
   a batch go through this together.

A link is a pair of tokens that end together: the last two of each group. How often a pair of ids is linked is
counted over the corpus: combined inside tasks, then summed. Back at the documents, the frequent pairs (at most
``head_pairs``, by a threshold on the count) are a broadcast table looked up where the
document's links are; links of all rarer pairs go through a shuffle join, in which no key is hot as the threshold bounds it.

A token's bytes are those of its spelling: byte-level decoded for side A (byte-level BPE behind one space), and for side B
(SentencePiece, which puts a space in front) the piece with its mark as a space, or the byte a byte piece names. Strings of special tokens
inside texts are plain text.

Defined cases: null and empty texts, and texts that either tokenizer changes (its joined bytes differ from a space and the text), have
no tokens, zeros and an empty digest; a null key is kept; repeated rows are counted and returned each; an empty table gives no rows;
only ``key`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, record_batch, slices, spread, written
from palimpsest.llm.packing import MAX_FAST_RUN, PATTERN, _byte_of

MARK = "▁"
#: A link's code: the A id above, the B id below this many bits.
SHIFT = 32
#: Counts are handed on when a task holds this many distinct pairs.
MAX_HELD = 400_000
_A: dict = {}
_B: dict = {}


def load_a(path: str):
    """``text -> ids`` and the bytes of every id, for a byte-level BPE file."""
    if path not in _A:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, byte_of = {t["content"]: t["id"] for t in spec["added_tokens"]}, _byte_of()
        spelling = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks={b: i for i, b in spelling.items()}, special_tokens={})
        run, whole = re.compile(r"\s{%d}" % MAX_FAST_RUN), []

        def encode(text: str) -> np.ndarray:
            if len(text) < MAX_FAST_RUN or not run.search(text):
                return np.asarray(fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), dtype=np.int64)
            if not whole:
                whole.append(Tokenizer.from_file(path))
                whole[0].encode_special_tokens = True
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, dtype=np.int64)

        spelling |= {i: t.encode() for t, i in special.items()}
        _A[path] = encode, [spelling.get(i, b"") for i in range(max(spelling) + 1)]
    return _A[path]


def load_b(path: str):
    """``texts -> lists of ids`` and the bytes of every id, for a SentencePiece model."""
    if path not in _B:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        _B[path] = (lambda texts: sp.encode(texts, num_threads=1),
                    [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
    return _B[path]


def group_labels(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A and each B token, given where they end (rising, with the same last end)."""
    na, nb = len(end_a), len(end_b)
    if not na:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    over_a, over_b = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    last = end_b[over_a] == end_a  # ends together with its partner
    to = np.concatenate([np.where(last, np.arange(na), na + over_a), over_b])
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            break
        to = farther
    number = np.cumsum(last) - 1  # of each terminal token
    label = number[to]
    return label[:na], label[na:]


class Batch:
    """Documents' tokens side by side: ids, ends and group labels over all documents,
    and per document where its tokens (``at_a``, ``at_b``) and groups (``at_g``) begin."""

    def __init__(self, texts: list[str | None], path_a: str, path_b: str):
        (encode_a, bytes_a), (encode_b, bytes_b) = load_a(path_a), load_b(path_b)
        self.ids_a, self.ids_b = [], []
        for text, b in zip(texts, encode_b([t or "" for t in texts])):
            a, want = np.zeros(0, np.int64), (" " + (text or "")).encode()
            if text and b"".join([bytes_b[i] for i in b]) == want:
                a = encode_a(" " + text)
                if b"".join([bytes_a[i] for i in a.tolist()]) != want:
                    a = a[:0]
            self.ids_a.append(a)
            self.ids_b.append(np.array(b if len(a) else [], np.int64))
        at = lambda parts: np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.at_a, self.at_b = at(self.ids_a), at(self.ids_b)
        self.a, self.b = np.concatenate(self.ids_a), np.concatenate(self.ids_b)
        size_a, size_b = (np.array([len(s) for s in spelt], np.int64) for spelt in (bytes_a, bytes_b))
        self.end_a, self.end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        self.group_a, self.group_b = group_labels(self.end_a, self.end_b)
        n = int(self.group_a[-1]) + 1 if len(self.a) else 0
        self.last_a = np.searchsorted(self.group_a, np.arange(n), side="right") - 1
        self.last_b = np.searchsorted(self.group_b, np.arange(n), side="right") - 1
        self.at_g = np.searchsorted(self.last_a, self.at_a)
        self.links = (self.a[self.last_a] << SHIFT) | self.b[self.last_b]

    def digests(self, spelt: tuple[list[bytes], ...]) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document; ``spelt``: see ``spellings``."""
        n = len(self.last_a)
        first_a, first_b = np.concatenate([[0], self.last_a + 1]), np.concatenate([[0], self.last_b + 1])
        # a group's A tokens stand behind all B tokens of earlier groups, its B tokens behind its own A tokens as well
        code = np.empty(len(self.a) + len(self.b), np.int64)
        wide = len(spelt[0]) // 2
        ends = np.zeros(len(self.a), np.int64)
        ends[self.last_a] = wide
        code[np.arange(len(self.a)) + first_b[self.group_a]] = self.a + ends
        ends, wide_b = np.zeros(len(self.b), np.int64), len(spelt[1]) // 2
        ends[self.last_b] = wide_b
        code[np.arange(len(self.b)) + first_a[self.group_b + 1]] = self.b + ends + len(spelt[0])
        words, out = spelt[0] + spelt[1] if n else [], []
        for i in range(len(self.ids_a)):
            lo, hi = self.at_a[i] + self.at_b[i], self.at_a[i + 1] + self.at_b[i + 1]
            line = b"".join([words[c] for c in code[lo:hi].tolist()])
            out.append(hashlib.sha256(line[:-1]).hexdigest() if line else "")
        return out


def spellings(n_a: int, n_b: int) -> tuple[list[bytes], list[bytes]]:
    """Decimal ids with what stands behind them, inside a group and at its end."""
    return ([b"%d," % i for i in range(n_a)] + [b"%d|" % i for i in range(n_a)],
            [b"%d," % i for i in range(n_b)] + [b"%d;" % i for i in range(n_b)])


def _lists(values: np.ndarray, at: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _whole(path_a: str, path_b: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                g = Batch(part.column("t").to_pylist(), path_a, path_b)
                per = lambda group, at: group - np.repeat(g.at_g[:-1], np.diff(at))
                ends = g.end_a[g.last_a] - np.repeat(np.concatenate([[0], g.end_a])[g.at_a[:-1]], np.diff(g.at_g))
                yield record_batch({
                    "k": part.column("k"), "a_ids": _lists(g.a, g.at_a, pa.int32()), "b_ids": _lists(g.b, g.at_b, pa.int32()),
                    "a_group": _lists(per(g.group_a, g.at_a), g.at_a, pa.int32()),
                    "b_group": _lists(per(g.group_b, g.at_b), g.at_b, pa.int32()), "group_end": _lists(ends, g.at_g, pa.int64())})

    return run


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, the ids of both sides, the group number of each token from 0, and the
    byte offset (in a space and the text) at which each group ends."""
    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = rows.schema["k"].dataType.simpleString()
    out = map_batches(rows, _whole(path_a, path_b), f"k {kind}, a_ids array<int>, b_ids array<int>, a_group array<int>, "
                                                    "b_group array<int>, group_end array<long>")
    return out.withColumnRenamed("k", key)


class Held:
    """Counts per code, merged when they are many."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> bool:
        self.parts.append((codes, counts))
        self.size += len(codes)
        if self.size > 4 * MAX_HELD:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
        return self.size > MAX_HELD and len(self.parts) == 1

    def merged(self):
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, counts = (np.concatenate(c) for c in zip(*self.parts))
        unique, place = np.unique(codes, return_inverse=True)
        return unique, np.bincount(place, weights=counts, minlength=len(unique)).astype(np.int64)

    def taken(self):
        out = self.merged()
        self.parts, self.size = [], 0
        return out


def _summaries(path_a: str, path_b: str):
    """A row per document, its distinct links in ``codes`` and ``times``; and rows without ``rid`` that
    carry the link counts of the task."""
    def run(batches):
        held, spelt, kind = Held(), None, None

        def counts():
            codes, times = held.taken()
            empty = pa.nulls(1, pa.int64())
            return record_batch({"rid": empty, "k": pa.nulls(1, kind), "n_a": empty, "n_b": empty, "n_groups": empty, "n_links": empty,
                                 "groups_sha256": pa.nulls(1, pa.string()), "codes": _lists(codes, np.array([0, len(codes)]), pa.int64()),
                                 "times": _lists(times, np.array([0, len(times)]), pa.int32())})

        for batch in batches:
            kind = batch.column("k").type
            for part in slices(batch, "t", 1 << 20):
                g = Batch(part.column("t").to_pylist(), path_a, path_b)
                spelt = spelt or spellings(len(load_a(path_a)[1]), len(load_b(path_b)[1]))
                n = len(g.ids_a)
                doc = np.repeat(np.arange(n), np.diff(g.at_g))
                order = np.lexsort((g.links, doc))
                codes, doc = g.links[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])])) if len(codes) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([first, [len(codes)]]))
                codes, at = codes[first], np.searchsorted(doc[first], np.arange(n + 1))
                groups = pa.array(np.diff(g.at_g), pa.int64())
                yield record_batch({
                    "rid": part.column("rid"), "k": part.column("k"), "n_a": pa.array(np.diff(g.at_a), pa.int64()),
                    "n_b": pa.array(np.diff(g.at_b), pa.int64()), "n_groups": groups, "n_links": groups,
                    "groups_sha256": pa.array(g.digests(spelt), pa.string()), "codes": _lists(codes, at, pa.int64()),
                    "times": _lists(times, at, pa.int32())})
                if held.add(codes, times):
                    yield counts()
        if held.size:
            yield counts()

    return run


def _scored(head):
    """Sums over each document's links that are in the broadcast table, and the links that are not."""
    def run(batches):
        known, count, best = head.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                lists, n = part.column("codes"), part.num_rows
                codes, times = (part.column(c).flatten().to_numpy() for c in ("codes", "times"))
                doc = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                found = known[place] == codes if len(known) else np.zeros(len(codes), bool)
                hit, weight = place[found], times[found].astype(np.int64)
                total = lambda w: pa.array(np.array([s.sum() for s in np.split(w, np.searchsorted(doc[found], np.arange(1, n)))], np.int64))
                at = np.searchsorted(doc[~found], np.arange(n + 1))
                out = {c: part.column(c) for c in ("rid", "k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                yield record_batch(out | {"n_best": total(weight * best[hit]), "count_sum": total(weight * count[hit]),
                                          "codes": _lists(codes[~found], at, pa.int64()), "times": _lists(times[~found], at, pa.int32())})

    return run


def link_counts(found: DataFrame) -> DataFrame:
    """``code, n_corpus, best`` of every linked pair of ids: the links that hold it, and whether no other pair with its B id has more."""
    pairs = found.where(F.col("rid").isNull()).select(F.explode(F.arrays_zip("codes", "times")).alias("p"))
    pairs = written(pairs.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.times").alias("n_corpus")))
    b_id = F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = pairs.groupBy(b_id.alias("b_id")).agg(F.max("n_corpus").alias("most"))
    return pairs.join(most, b_id == F.col("b_id")).select("code", "n_corpus", (F.col("n_corpus") == F.col("most")).alias("best"))


def link_summary(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text",
                 head_pairs: int = 1_000_000) -> DataFrame:
    """Per document: ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = rows.schema["k"].dataType.simpleString()
    plain = f"rid long, k {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    # numbered before they are written: repeated tasks read the numbers back
    found = written(map_batches(rows.withColumn("rid", F.monotonically_increasing_id()), _summaries(path_a, path_b),
                                plain + ", codes array<long>, times array<int>"))
    pairs = written(link_counts(found))
    size = F.floor(F.log2("n_corpus")).cast("int")
    least, held, rest = 0, 0, 0
    for r in sorted(pairs.groupBy(size.alias("size")).count().collect(), reverse=True):  # a row per power of two
        if held + r["count"] > head_pairs or rest:
            rest += r["count"]
        else:
            held, least = held + r["count"], 1 << r["size"]
    head = pairs.where(F.col("n_corpus") >= least).orderBy("code").toArrow() if held else None
    arrays = [head.column(c).to_numpy() for c in ("code", "n_corpus", "best")] if held else [np.zeros(0, np.int64)] * 3
    scored = map_batches(found.where(F.col("rid").isNotNull()), _scored(docs.sparkSession.sparkContext.broadcast(arrays)),
                         plain + ", n_best long, count_sum long, codes array<long>, times array<int>")
    names = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if rest:
        scored = written(scored)
        tail = scored.select("rid", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("rid", "p.codes", "p.times")
        tail = tail.join(pairs.where(F.col("n_corpus") < least) if held else pairs, F.col("codes") == F.col("code")).groupBy("rid").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n_corpus")).alias("more_sum"))
        scored = scored.join(tail, "rid", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn(
            "count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return scored.withColumnRenamed("k", key).select(*names)
