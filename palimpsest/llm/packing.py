"""Packing by power-of-two decomposition.

A document's ids (an end id appended) are cut into as many pieces of ``max_len`` as fit and, for the
rest, pieces of the binary digits of its length, longest first. A piece is a
sequence by itself: no sequence crosses documents, lengths are powers of two, so
nothing is padded. Pieces of equal length form a bucket; ``sequence_id`` counts
through the buckets from long to short without gaps, so the sequences of a bucket are one
range of numbers that a reader can batch.

Numbers come from two counts: each task numbers its pieces per length, and running
totals of those counts over tasks give where each task starts. Only the counts, one row
for each task and length, are shuffled.

Ids are those of ``tokenizers`` for the same JSON file (special strings inside texts
included); they are computed with ``tiktoken`` over the ranks in that file,
which is four times faster, and by ``tokenizers`` where that refuses a text.

Defined cases: a null or empty text is its end id alone, one piece of length 1; a null
key is kept; rows repeated are packed each; an empty table gives no pieces; only
``key`` and ``text`` are read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, materialised, record_batch, slices, spread
from palimpsest.operators.sizing import broadcast_if_bounded

#: Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a longer run of white space go to ``tokenizers``, whose pattern engine has no step limit.
MAX_FAST_RUN = 100_000
_ENCODERS: dict = {}


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1
    stands for itself, the other bytes for characters from 256 up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def load_encoder(path: str):
    """``text -> numpy ids`` for the byte-level BPE file at ``path``, once per worker."""
    if path not in _ENCODERS:
        import re

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i
                 for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        whole: list = []  # loaded when first needed
        run = re.compile(r"\s{%d}" % MAX_FAST_RUN)

        def encode(text: str) -> np.ndarray:
            if len(text) < MAX_FAST_RUN or not run.search(text):
                return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
            whole or whole.append(Tokenizer.from_file(path))
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: ``max_len`` (a power of two) as often as
    it fits, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(path: str, max_len: int, end_id: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        encode, task = load_encoder(path), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                row, start, length, crc, total, rank, ids = [], [], [], [], [], [], []
                for i, text in enumerate(part.column("t").to_pylist()):
                    doc = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    at = 0
                    for n in piece_lengths(len(doc), max_len):
                        piece = doc[at:at + n]
                        row.append(i)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(doc))
                        rank.append(seen.get(n, 0))
                        seen[n] = rank[-1] + 1
                        if with_ids:
                            ids.append(piece)
                        at += n
                out = {"k": part.column("k").take(pa.array(row, pa.int32()))}
                for name, values in (("start", start), ("length", length), ("ids_crc32", crc),
                                     ("doc_tokens", total), ("rank", rank)):
                    out[name] = pa.array(values, pa.int64())
                out["task"] = pa.array([task] * len(row), pa.int32())
                if with_ids:
                    out["ids"] = pa.array([p.astype(np.int32) for p in ids], pa.list_(pa.int32()))
                yield record_batch(out)

    return run


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text",
         max_len: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, if asked for, the ids themselves."""
    rows = spread(docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")))
    kind = rows.schema["k"].dataType.simpleString()
    schema = (f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, rank long, task int"
              + (", ids array<int>" if with_ids else ""))
    pieces = materialised(map_batches(rows, _pieces(tokenizer_path, max_len, end_id, with_ids), schema))
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "task", before.alias("task_start"))
    # one number per length, and lengths are powers of two up to max_len
    totals, bucket_start = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, {}
    at = 0
    for n in sorted(totals, reverse=True):
        bucket_start[n] = at
        at += totals[n]
    if not totals:
        bucket_start = {1: 0}
    base = F.create_map(*[F.lit(x).cast("long") for pair in bucket_start.items() for x in pair])
    starts, _ = broadcast_if_bounded(starts)
    out = pieces.join(starts, ["length", "task"])
    return out.select(
        F.col("k").alias(key), "start", "length", "ids_crc32", "doc_tokens",
        (base[F.col("length")] + F.col("task_start") + F.col("rank")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
