"""Suffix-array deduplication: remove bytes of passages that occur earlier.

A byte goes when a ``width``-byte string that covers it also starts earlier, in a smaller
document or earlier in the same one. Strings are judged on the input.

1. Each string is represented by its minimiser, the least hash of the ``K``-byte
   strings inside. Runs of strings with the same minimiser form a *cut*, a stretch of text; equal
   strings have equal minimisers. Only cuts go on whose minimiser has another cut, or occurs
   again inside its own (periodic text).
2. Cuts are compared whole by hash and length: of equal cuts, all strings of all but the
   earliest are repeats.
3. Distinct cuts of one minimiser, and periodic ones, may still share strings. Their texts are
   concatenated and suffix sorted by linear grouping (``suffix_groups``); strings
   that agree in ``width`` bytes stand side by side, and all but the
   earliest are repeats. A minimiser with more than ``MAX_BYTES`` of distinct cuts is
   not gathered: its cuts are taken apart into strings, and an aggregation over
   their digests finds the earliest of each, whatever their number.
4. The runs of repeats of a document are merged and cut out of its bytes.

Order of documents: by key, null first; rows that share a key by their text; each row is a
document of its own. A document is a key and a 64-bit number among the rows of that key, counted
over ranges of texts, so neither the rows of one key nor their tasks are bounded. Defined cases: a null text counts as empty; texts shorter than ``width``
have no repeats; an empty table gives an empty result; only ``key`` and
``text`` are read. Long texts are scanned in blocks, so memory follows the block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import map_batches, record_batch, slices, spread, written
from palimpsest.llm.suffix_groups import suffix_array
from palimpsest.operators.sizing import broadcast_if_bounded
from palimpsest.session import text_partitions

K, MAX_BYTES = 32, 4 << 20
BLOCK = 1 << 20  # strings scanned at a time
CHUNK = 1 << 18  # bytes of cuts taken up at a time, or one minimiser's cuts if more
SORTED = 1 << 15  # bytes suffix sorted at a time, or what one minimiser's cuts share if more
HEAD = 256  # characters by which rows of one key are dealt out to be numbered
COPIES = 1000  # rows of one key and head, all of one text, that are dealt out at random
PRIME = 0x9E3779B97F4A7C15
_POWERS: list = []


def _powers(n: int):
    """Powers of an odd multiplier and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        out = []
        for base in (PRIME, pow(PRIME, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size``-byte string of ``data``."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    h = (total[size:] - total[:-size]) * down[:len(data) - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def cuts(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, n, minimiser, again)``: runs of string starts ``start .. start + n`` with one
    minimiser, and whether that occurs again inside."""
    out = []
    data, n_strings, span = np.frombuffer(raw, np.uint8), len(raw) - width + 1, width - K + 1
    for at in range(0, n_strings, BLOCK):
        h = _hashes(data[at:at + BLOCK + width - 1], K)
        least, done = h, 1
        while done * 2 <= span:
            least, done = np.minimum(least[:-done], least[done:]), done * 2
        if done < span:
            least = np.minimum(least[:-(span - done)], least[span - done:])
        change = least[1:] != least[:-1]
        first = np.flatnonzero(np.r_[True, change])
        recurs = np.r_[False, ~change & (h[span:] == least[1:])]
        # at the first string of a cut it may occur twice already
        twice = np.add.reduceat(recurs, first) > 0
        for i in np.flatnonzero(~twice).tolist() if len(first) < 3 else ():
            a = first[i]
            twice[i] = (h[a:a + span] == least[a]).sum() > 1
        out.append((first + at, np.diff(np.r_[first, len(least)]), least[first].view(np.int64), twice))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    return tuple(np.concatenate(x) for x in zip(*out))


def _minimisers(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                found = [cuts(t.encode(), width) for t in part.column("t").to_pylist()]
                key, again = (np.concatenate([f[i] for f in found]) for i in (2, 3))
                keys, counts = np.unique(np.r_[key, key[again]], return_counts=True)
                yield record_batch({"m": pa.array(keys.astype(np.int64)), "c": pa.array(np.minimum(counts, 2))})

    return run


def _occurrences(width: int):
    """All cuts; ``n`` is negative where the minimiser occurs again inside."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                row, start, n, m, cut = [], [], [], [], []
                for i, text in enumerate(part.column("t").to_pylist()):
                    raw = text.encode()
                    s, c, k, again = cuts(raw, width)
                    row.append(np.full(len(s), i, np.int32))
                    start.append(s)
                    n.append(np.where(again, -c, c))
                    m.append(k)
                    cut += [xxh3_64_intdigest(raw[a:b]) for a, b in zip(s.tolist(), (s + c + width - 1).tolist())]
                row, start = pa.array(np.concatenate(row)), np.concatenate(start).astype(np.int32)
                yield record_batch({
                    "m": pa.array(np.concatenate(m).astype(np.int64)),
                    "cut": pa.array(np.array(cut, np.uint64).view(np.int64)),
                    "n": pa.array(np.concatenate(n).astype(np.int32)),
                    "k": part.column("k").take(row), "o": part.column("o").take(row), "start": pa.array(start)})

    return run


# -------------------------------------------------------- distinct cuts of one minimiser

def shared_parts(texts: list[bytes], width: int) -> list[tuple[int, int, int]]:
    """``(text, start, end)``: the part of each text between its first and last string whose
    hash occurs twice in ``texts``; no other string can be a repeat."""
    sizes = np.array([len(t) for t in texts])
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    h = _hashes(np.frombuffer(b"".join(texts), np.uint8), width)
    n = sizes - width + 1
    owner = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    _, place, count = np.unique(h[begin[owner] + offset], return_inverse=True, return_counts=True)
    twice = count[place] > 1
    owner, offset = owner[twice], offset[twice]
    if not len(owner):
        return []
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    last = np.r_[first[1:], len(owner)] - 1
    return list(zip(owner[first].tolist(), offset[first].tolist(), (offset[last] + width).tolist()))


def repeated_runs(texts: list[bytes], width: int) -> list[tuple[int, int, int]]:
    """``(text, start, n)``: strings of each text that an earlier text, or itself earlier, has
    too, as runs of starts."""
    joined = b"\x00".join(texts) + b"\x00"
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.array(suffix_array(joined), np.int64)
    order = order[(sizes[owner] - 1 - offset)[order] >= width].tolist()
    hits: list[int] = []
    run, word = [], None
    for p in order:
        w = joined[p:p + width]
        if w == word:
            run.append(p)
        else:
            if len(run) > 1:
                run.remove(min(run))
                hits += run
            run, word = [p], w
    if len(run) > 1:
        run.remove(min(run))
        hits += run
    if not hits:
        return []
    hits = np.sort(np.array(hits))
    first = np.flatnonzero(np.r_[True, (np.diff(hits) != 1) | (owner[hits[1:]] != owner[hits[:-1]])])
    counts = np.diff(np.r_[first, len(hits)])
    return list(zip(owner[hits[first]].tolist(), offset[hits[first]].tolist(), counts.tolist()))


def _compare(width: int):
    """Runs of repeats among distinct cuts; input sorted by minimiser, key, number and start. Equal
    strings have equal minimisers, so minimisers taken up together do not mix."""

    def result(table):
        m, texts = table.column("m").to_numpy(), table.column("bytes").to_pylist()
        first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]).tolist() + [len(m)]
        out, lo, total = [], 0, 0
        for a, b in zip(first, first[1:]):
            total += sum(map(len, texts[a:b]))
            if total < CHUNK and b < len(m):
                continue
            parts, held, size = shared_parts(texts[lo:b], width), [], 0
            for i, (t, s, e) in enumerate(parts):
                held.append((lo + t, s, texts[lo + t][s:e]))
                size += e - s
                if i + 1 == len(parts) or size >= SORTED and m[lo + parts[i + 1][0]] != m[lo + t]:
                    out += [(held[j][0], held[j][1] + at, n) for j, at, n in repeated_runs([x for _, _, x in held], width)]
                    held, size = [], 0
            lo, total = b, 0
        at = pa.array([x[0] for x in out], pa.int32())
        start = table.column("start").to_numpy()[[x[0] for x in out]] if out else np.zeros(0, np.int32)
        return record_batch({"k": table.column("k").take(at), "o": table.column("o").take(at),
                             "start": pa.array(start + np.array([x[1] for x in out], np.int32)),
                             "n": pa.array([x[2] for x in out], pa.int32())})

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            m = held.column("m").to_numpy()
            last = np.flatnonzero(m[1:] != m[:-1])
            if len(last):  # the last minimiser may go on in the next batch
                cut = int(last[-1]) + 1
                yield result(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield result(held)

    return run


# ----------------------------------------------------------------- documents

def _cut_texts(width: int):
    """The bytes of asked-for cuts, from rows of a text and its list of cuts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                row, m, start, data = [], [], [], []
                for i, (text, asked) in enumerate(zip(part.column("t").to_pylist(), part.column("asked").to_pylist())):
                    raw = text.encode()
                    for a in asked:
                        row.append(i)
                        m.append(a["m"])
                        start.append(a["start"])
                        data.append(raw[a["start"]:a["start"] + abs(a["n"]) + width - 1])
                at = pa.array(row, pa.int32())
                yield record_batch({"m": pa.array(m, pa.int64()), "k": part.column("k").take(at), "o": part.column("o").take(at),
                                    "start": pa.array(start, pa.int32()), "bytes": pa.array(data, pa.binary())})

    return run


def removed_spans(starts: np.ndarray, counts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings at ``starts .. starts + counts``."""
    order = np.argsort(starts, kind="stable")
    lo, hi = starts[order], (starts + counts + width - 1)[order]
    reach = np.maximum.accumulate(hi)
    first = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
    return list(zip(lo[first].tolist(), reach[np.r_[first[1:] - 1, len(lo) - 1]].tolist()))


def _remaining(text: str, runs, width: int) -> tuple[bytes, list[tuple[int, int]], bytes]:
    raw = text.encode()
    if not runs:
        return raw, [], raw
    spans = removed_spans(np.array([r["start"] for r in runs], np.int64), np.array([r["n"] for r in runs], np.int64), width)
    ends = [0] + [b for _, b in spans]
    return raw, spans, b"".join(raw[a:b] for a, b in zip(ends, [a for a, _ in spans] + [len(raw)]))


def _clean(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                done = [_remaining(t, r, width) for t, r in zip(*(part.column(c).to_pylist() for c in ("t", "runs")))]
                yield record_batch({
                    "k": part.column("k"), "o": part.column("o"),
                    "n_bytes": pa.array([len(raw) for raw, _, _ in done], pa.int64()),
                    "n_removed": pa.array([len(raw) - len(kept) for raw, _, kept in done], pa.int64()),
                    "n_spans": pa.array([len(spans) for _, spans, _ in done], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(kept).hexdigest() for _, _, kept in done], pa.string())})

    return run


def _rest(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                texts = [_remaining(t, r, width)[2].decode("utf-8", "ignore")
                         for t, r in zip(*(part.column(c).to_pylist() for c in ("t", "runs")))]
                yield record_batch({"row": part.column("row"), "text": pa.array(texts, pa.string())})

    return run


def _count_along():
    """``b``, the task, and ``i``, the number of a row among those of its key in the task;
    input sorted by key."""

    def run(batches):
        from pyspark import TaskContext

        task, key, seen = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            numbers = []
            for k in batch.column("k").to_pylist():
                seen = seen + 1 if k == key else 0
                key = k
                numbers.append(seen)
            yield record_batch({**dict(zip(batch.schema.names, batch.columns)),
                                "b": pa.array([task] * batch.num_rows, pa.int32()), "i": pa.array(numbers, pa.int64())})

    return run


def _numbered_by_text(rows: DataFrame) -> DataFrame:
    """``rows`` with ``o``, their number among those of their key in the order of ``t``. Rows
    are dealt out in ranges of key and head of the text, counted inside a range, and
    the counts of the ranges before are added, so one key's rows spread over many tasks. Texts of one
    key and head stay together, unless they are copies, whose order does not matter."""
    spark = rows.sparkSession
    names = rows.columns
    head = F.substring("t", 1, HEAD)
    copies = rows.select("k", F.xxhash64(head).alias("h"), F.xxhash64("t").alias("x")).groupBy(
        F.col("k").alias("ck"), F.col("h").alias("ch")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("z")).where(
        (F.col("n") >= COPIES) & (F.col("a") == F.col("z"))).select("ck", "ch")
    copies, _ = broadcast_if_bounded(copies)
    dealt = rows.withColumn("h", F.xxhash64(head)).join(
        copies, F.col("k").eqNullSafe(F.col("ck")) & (F.col("h") == F.col("ch")), "left").withColumn(
        "salt", F.when(F.col("ch").isNotNull(), F.rand(1)).otherwise(0.0)).select(*names, "salt")
    dealt = dealt.repartitionByRange(text_partitions(spark), "k", head, "salt").sortWithinPartitions("k", "t")
    schema = T.StructType([*rows.schema.fields, T.StructField("b", T.IntegerType()), T.StructField("i", T.LongType())])
    counted = written(map_batches(dealt.select(*names), _count_along(), schema))
    before = Window.partitionBy("bk").orderBy("bb").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.groupBy(F.col("k").alias("bk"), F.col("b").alias("bb")).agg(F.count(F.lit(1)).alias("n")).select(
        "bk", "bb", F.sum("n").over(before).alias("base")).where("base > 0")
    bases, _ = broadcast_if_bounded(bases)
    return counted.join(bases, F.col("k").eqNullSafe(F.col("bk")) & (F.col("b") == F.col("bb")), "left").select(
        *names, (F.coalesce("base", F.lit(0)) + F.col("i")).alias("o"))


def numbered(docs: DataFrame, key: str, text: str, carry: bool = False) -> DataFrame:
    """``k, t, o``: rows with ``o`` numbering those that share a key, by text; with
    ``carry`` also ``row``, the whole row but for its text."""
    rest = [F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row")] if carry else []
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"), *rest)
    names, zero = ["k", "t"] + (["row"] if carry else []), F.lit(0).cast("long").alias("o")
    shared = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("s"))
    shared, _ = broadcast_if_bounded(shared)
    if shared.isEmpty():
        return rows.select(*names, zero)
    same = F.col("k").eqNullSafe(F.col("s"))
    return rows.join(shared, same, "left_anti").select(*names, zero).unionByName(
        _numbered_by_text(rows.join(shared, same, "left_semi").select(*names)))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 100) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.
    ``o`` tells rows of one key apart."""
    rows = spread(numbered(docs, key, text))
    kind = rows.schema["k"].dataType.simpleString()
    schema = f"k {kind}, o long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_batches(_marked(rows, width).drop("row"), _clean(width), schema).withColumnRenamed("k", key)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars",
                width: int = 100) -> DataFrame:
    """``docs`` with what remains of every text (a character cut in two goes whole) and,
    if there is such a column, its new ``length`` in characters."""
    rows = spread(numbered(docs, key, text, carry=True))
    row = next(f for f in rows.schema.fields if f.name == "row")
    schema = T.StructType([row, T.StructField("text", T.StringType())])
    out = map_batches(_marked(rows, width), _rest(width), schema)
    new = {text: F.col("text")}
    if length in docs.columns:
        new[length] = F.char_length("text").cast(docs.schema[length].dataType)
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def _marked(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``runs``, the strings to remove as runs of starts."""
    kind = rows.schema["k"].dataType.simpleString()
    texts = rows.where(F.octet_length("t") >= width).select("k", "o", "t")
    twice = map_batches(texts.select("t"), _minimisers(width), "m long, c long").groupBy("m").agg(
        F.sum("c").alias("c")).where("c > 1").select("m")
    occurrences = map_batches(texts, _occurrences(width), f"m long, cut long, n int, k {kind}, o long, start int")
    found = written(occurrences.join(twice, "m"))
    # 2. equal cuts
    at = F.struct("k", "o", "start")
    distinct = written(found.groupBy("m", "cut", "n").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("c")))
    later = found.join(distinct.where("c > 1").select("m", "cut", "n", "first"), ["m", "cut", "n"]).where(
        ~at.eqNullSafe(F.col("first"))).select("k", "o", "start", F.abs("n").alias("n"))
    # 3. distinct cuts of one minimiser, periodic cuts
    several = distinct.groupBy("m").agg(
        F.count(F.lit(1)).alias("cuts"), F.min("n").alias("n"),
        F.sum(F.abs("n") + width - 1).alias("bytes")).where("cuts > 1 OR n < 0").select("m", "bytes")
    asked = distinct.join(several, "m").select("m", "n", "first.*")
    lists = asked.groupBy(F.col("k").alias("ak"), F.col("o").alias("ao")).agg(
        F.collect_list(F.struct("m", "start", "n")).alias("asked"))
    lists, _ = broadcast_if_bounded(lists)
    wanted = texts.join(lists, F.col("k").eqNullSafe(F.col("ak")) & (F.col("o") == F.col("ao"))).select("k", "o", "t", "asked")
    pieces = map_batches(wanted, _cut_texts(width), f"m long, k {kind}, o long, start int, bytes binary")
    crowded, _ = broadcast_if_bounded(several.where(F.col("bytes") > MAX_BYTES).select("m"))
    if not crowded.isEmpty():
        pieces = written(pieces)
        later = later.unionByName(_by_string(pieces.join(crowded, "m", "left_semi"), width))
        pieces = pieces.join(crowded, "m", "left_anti")
    sorted_ = pieces.repartition("m").sortWithinPartitions("m", "k", "o", "start")
    runs = later.unionByName(map_batches(sorted_, _compare(width), f"k {kind}, o long, start int, n int"))
    # 4. documents
    per_doc = runs.groupBy(F.col("k").alias("rk"), F.col("o").alias("ro")).agg(
        F.collect_list(F.struct("start", "n")).alias("runs"))
    return rows.join(per_doc, F.col("k").eqNullSafe(F.col("rk")) & (F.col("o") == F.col("ro")), "left").drop("rk", "ro")


def _by_string(pieces: DataFrame, width: int) -> DataFrame:
    """Repeats among the cuts of crowded minimisers, string by string."""
    strings = pieces.select("m", "k", "o", "start", "bytes", F.explode(
        F.sequence(F.lit(0), F.octet_length("bytes") - width)).alias("i")).select(
        "m", F.sha2(F.substring("bytes", F.col("i") + 1, F.lit(width)), 256).alias("s"), "k", "o",
        (F.col("start") + F.col("i")).alias("start"))
    strings = written(strings)
    least = strings.groupBy("m", "s").agg(F.min(F.struct("k", "o", "start")).alias("first"),
                                          F.count(F.lit(1)).alias("c")).where("c > 1")
    return strings.join(least, ["m", "s"]).where(~F.struct("k", "o", "start").eqNullSafe(F.col("first"))).select(
        "k", "o", "start", F.lit(1).alias("n"))
