"""SimHash near-deduplication over a Gray-order hierarchical index.

Fingerprints: one bit is set where more than half of a text's shingle hashes
have it set. Distinct fingerprints that differ in at most ``max_bits`` bits are linked,
and a document's class is its connected component.

Search. Fingerprints within ``max_bits`` of each other agree wholly in at least one of
``max_bits + 1`` blocks of their bits, so each goes to one group per block,
keyed by the masked pattern. A group larger than ``MAX_GROUP`` is not gathered: its members
go on to the sub-groups of the blocks of the bits not yet masked, by the same
argument, until no group is larger; few bits are left free by then, so this ends.
Inside a group members are sorted by Gray rank, where neighbours share long
patterns; runs of ``FANOUT`` make a node that holds the bits its
members share, runs of nodes make upper nodes, and each bit pattern is kept at the highest
node that shares it. A search adds up differences from the root down and drops a
whole node as soon as they exceed ``max_bits``. Links leave a group as a
star per local component, at most one per member, never as all pairs.

Defined cases: a null or empty text, or one of white space only, has the fingerprint zero; texts with
fewer words than a shingle are one shingle; a null key gets a class like others but is
no class id (the least non-null key is; null if there is none); rows repeated are classed each;
an empty table gives an empty result; only ``key`` and ``text`` are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import LOWER, UPPER, map_batches, materialised, record_batch, slices, spread, without
from palimpsest.llm.components import connected_components
from palimpsest.operators.sizing import broadcast_if_bounded

SEED, MAX_GROUP, FANOUT = 42, 4096, 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    from xxhash import xxh64_digest

    words = WORD.findall(text.encode().translate(FOLD)) if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(shingle, len(words))
    first, last = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), 1 << 16):
        digests = b"".join([xxh64_digest(joined[a:b], SEED)
                            for a, b in zip(first[at:at + (1 << 16)], last[at:at + (1 << 16)])])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(first)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                texts = part.column("t").to_pylist()
                fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
                same = np.array([xxh64_intdigest((t or "").encode(), SEED) for t in texts], np.uint64)
                yield record_batch({"k": part.column("k"), "text_hash": pa.array(same.view(np.int64)),
                                    "fp": pa.array(fps.view(np.int64))})

    return run


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return map_batches(rows, _fingerprints(shingle), f"k {rows.schema['k'].dataType.simpleString()}, text_hash long, fp long")


# ------------------------------------------------------------------- groups

def blocks_of(mask: int, n: int) -> list[int]:
    """The bits free in ``mask`` as ``n`` runs; each run joined to ``mask``, as signed numbers."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(i * len(free) / n) for i in range(n + 1)]
    out = [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def gray_rank(fp: Column) -> Column:
    """The place of ``fp`` in the sequence of Gray codes."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _members(fps: DataFrame, n_blocks: int) -> DataFrame:
    """``(mask, value, fp)``: groups of more than one and at most ``MAX_GROUP`` members."""

    def joined(rows: DataFrame, masks: Column) -> DataFrame:
        return rows.select("fp", F.explode(masks).alias("mask")).withColumn(
            "value", F.col("fp").bitwiseAND(F.col("mask")))

    masks, done = [0], None
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        below = {m: blocks_of(m % (1 << 64), n_blocks) for m in masks}
        table = F.create_map(*[x for m, subs in below.items() for x in (
            F.lit(m).cast("long"), F.array(*[F.lit(s).cast("long") for s in subs]))])
        rows = materialised(joined(rows, table[F.col("mask")]))
        masks = [s for subs in below.values() for s in subs]
        large, small_enough = broadcast_if_bounded(
            rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_GROUP).select(
                "mask", "value"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fine = rows.join(large, ["mask", "value"], "left_anti").select("fp", "mask", "value")
        done = fine if done is None else done.unionByName(fine)
        rows = rows.join(large, ["mask", "value"], "left_semi").select("fp", "mask")


# -------------------------------------------------------------------- index

def index_levels(codes: np.ndarray, group: np.ndarray) -> list[tuple]:
    """Nodes over codes sorted by group and Gray rank, leaves' parents first. A level is
    ``(start, mask, pattern)``: where each node's children start in the level below
    (with an end), and the bits that all its codes share."""
    levels, of = [], group
    ones, zeros = codes, ~codes
    while True:
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
        start = np.flatnonzero((place % FANOUT) == 0)
        ones, zeros = np.bitwise_and.reduceat(ones, start), np.bitwise_and.reduceat(zeros, start)
        levels.append((np.r_[start, len(of)], ones | zeros, ones))
        of = of[start]
        if len(of) == len(np.unique(of)):
            return levels


def search(codes: np.ndarray, group: np.ndarray, max_bits: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)``, ``i < j``, of one group within ``max_bits``, for the codes
    ``at``. ``group`` numbers the groups from 0 in order."""
    levels = index_levels(codes, group)
    query, node = at, group[at]
    diff, above = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
    for start, mask, pattern in reversed(levels):
        fresh = mask[node] & ~above  # bits already compared higher up are not compared again
        diff = diff + np.bitwise_count((codes[query] ^ pattern[node]) & fresh)
        ok = diff <= max_bits
        query, node, diff = query[ok], node[ok], diff[ok]
        n = start[node + 1] - start[node]
        above = np.repeat(mask[node], n)
        child = np.repeat(start[node], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        query, diff, node = np.repeat(query, n), np.repeat(diff, n), child
    later = node > query
    query, node, diff, above = query[later], node[later], diff[later], above[later]
    diff = diff + np.bitwise_count((codes[query] ^ codes[node]) & ~above)
    ok = diff <= max_bits
    return query[ok], node[ok]


def _roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of ``i`` and ``j`` in ``label`` (class -> least member)."""
    while True:
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _links(max_bits: int):
    def stars(mask, value, fp):
        change = np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
        group = np.cumsum(change) - 1
        size = np.bincount(group)
        keep = size[group] > 1
        codes, group = fp[keep].view(np.uint64), np.unique(group[keep], return_inverse=True)[1]
        label = np.arange(len(codes))
        for lo in range(0, len(codes), 4096):
            _roots(label, *search_in(codes, group, max_bits, lo, min(lo + 4096, len(codes))))
        far = label != np.arange(len(codes))
        signed = codes.view(np.int64)
        return record_batch({"a": pa.array(signed[far]), "b": pa.array(signed[label[far]])})

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("mask", "value", "fp"))]
            if len(held[0]) < 200_000:
                continue
            mask, value, _ = held
            last = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
            if len(last):  # the last group may go on in the next batch
                cut = last[-1] + 1
                yield stars(*[h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield stars(*held)

    return run


def search_in(codes, group, max_bits, lo, hi):
    """``search`` for the codes ``lo`` to ``hi`` over the index of just their groups."""
    first, last = np.searchsorted(group, group[lo]), np.searchsorted(group, group[hi - 1], "right")
    i, j = search(codes[first:last], group[first:last] - group[first], max_bits, np.arange(lo - first, hi - first))
    return i + first, j + first


def _classes(docs: DataFrame, key: str, text: str, shingle: int, max_bits: int) -> DataFrame:
    """``k, fp, text_hash`` of every row and ``first``, its class's first row as ``(null key?, k, text_hash)``."""
    prints = materialised(fingerprints(docs, key, text, shingle))
    nodes = materialised(prints.groupBy("fp").agg(F.min(F.struct(F.col("k").isNull().alias("no_key"), "k", "text_hash")).alias("least")))
    members = _members(nodes, max_bits + 1)
    sorted_ = members.withColumn("rank", gray_rank(F.col("fp"))).repartition("mask", "value").sortWithinPartitions(
        "mask", "value", "rank").select("mask", "value", "fp")
    roots = connected_components(map_batches(sorted_, _links(max_bits), "a long, b long"))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = linked.groupBy("root").agg(F.min("least").alias("first"))
    return prints.join(linked.join(of_root, "root").select("fp", "first"), "fp")


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                  max_bits: int = 2) -> DataFrame:
    """``key, fingerprint, component_id, text_hash`` for every row of ``docs``; the last is
    Spark's ``xxhash64`` of the text, which tells rows of one key apart."""
    return _classes(docs, key, text, shingle, max_bits).select(
        F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.k").alias("component_id"),
        "text_hash")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                     max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, whole, that stay: of each class the one with the smallest key (null
    keys last) and, among rows of that key, the smallest text hash. Rows equal in key and text are one."""
    gone = _classes(docs, key, text, shingle, max_bits).where(
        ~(F.col("k").eqNullSafe(F.col("first.k")) & (F.col("text_hash") == F.col("first.text_hash")))).select("k", "text_hash")
    return without(docs, gone.distinct(), {
        "k": F.col(key), "text_hash": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
