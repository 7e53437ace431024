"""Token counts without token ids.

BPE merges never cross a point that no piece of the vocabulary spans: before a word-start mark
and between letters and other characters (checked when the model is loaded). A text is
therefore a bag of pre-tokens, each a run of letters or of other characters with the spaces
in front, whose piece counts add up:

1. pre-token frequencies of the corpus, combined in the map tasks;
2. pieces counted once per distinct pre-token;
3. the counts joined to the pre-token frequencies of each document and summed.

The join has two exact ways. The most frequent pre-tokens, up to
``head_bytes`` of them by measured size, travel as a broadcast table and are summed where the
text is; the frequencies of all others go through a shuffle join. As those are rare
by definition, no key of that join is hot.

Defined cases: a null text counts as empty, with no tokens; a null key is kept;
rows repeated give one row each; an empty table gives an empty result; only
``key`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, record_batch, slices, spread, written

MARK = "▁"
#: Letters, or anything else; the superscript two counts as no letter (one piece has a full stop behind it).
PRE_TOKEN = re.compile(r" *[^\W\d_²]+| *(?:[^\w ]|[\d_²])+| +")
#: Frequencies are handed on when a task holds this many distinct pre-tokens.
MAX_HELD = 600_000
_MODELS: dict = {}


def load_model(path: str):
    """The SentencePiece processor at ``path``, loaded once per worker."""
    if path not in _MODELS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                piece = sp.id_to_piece(i).replace(MARK, " ")
                assert PRE_TOKEN.fullmatch(piece) and "\n" not in piece, \
                    "a piece spans pre-tokens; counts would not add up"
        _MODELS[path] = sp
    return _MODELS[path]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of ``text`` behind the one space that the library puts in front."""
    if not text:
        return []
    if MARK in text:  # the library takes the mark for a space
        text = text.replace(MARK, " ")
    return PRE_TOKEN.findall(" " + text)


def piece_counts(sp, pre: list[str]) -> list[int]:
    """Pieces of each pre-token. A line feed in front, which no piece spans, keeps
    the space that the library adds (and the line feed, two pieces) apart from it."""
    return [len(ids) - 2 for ids in sp.encode(["\n" + x for x in pre], num_threads=1)]


def _corpus_frequencies(batches):
    held: Counter = Counter()

    def flush():
        out = record_batch({"pre": pa.array(list(held), pa.string()),
                            "n": pa.array(list(held.values()), pa.int64())})
        held.clear()
        return out

    for batch in batches:
        for part in slices(batch, "t"):
            for text in part.column("t").to_pylist():
                held.update(pre_tokens(text))
                if len(held) > MAX_HELD:
                    yield flush()
    if held:
        yield flush()


def _count_pieces(path: str):
    def run(batches):
        sp = load_model(path)
        for batch in batches:
            pieces = piece_counts(sp, batch.column("pre").to_pylist())
            yield record_batch({"pre": batch.column("pre"), "n": batch.column("n"),
                                "pieces": pa.array(pieces, pa.int64())})

    return run


def vocabulary(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``pre, n, pieces``: every distinct pre-token, its corpus frequency and pieces."""
    texts = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull())
    freq = map_batches(texts, _corpus_frequencies, "pre string, n long")
    return map_batches(freq.groupBy("pre").agg(F.sum("n").alias("n")), _count_pieces(model_path),
                       "pre string, n long, pieces long")


def _head(vocab: DataFrame, head_bytes: int) -> tuple[int, dict[str, int]]:
    """The least frequency of the broadcast part, and that part: as many of the most
    frequent pre-tokens as fit ``head_bytes``, by a histogram over powers of two."""
    level = F.floor(F.log2("n")).cast("int")
    # 120 bytes: a Python string with its number in a dict, besides its characters
    sizes = vocab.groupBy(level.alias("level")).agg(
        F.sum(F.octet_length("pre") + 120).alias("b")).collect()
    total, least = 0, 62
    for row in sorted(sizes, key=lambda r: -r.level):
        total += row.b
        if total > head_bytes:
            break
        least = row.level
    rows = vocab.where(level >= least).select("pre", "pieces").toPandas()
    return 2 ** least, dict(zip(rows["pre"], rows["pieces"].tolist()))


def _documents(head):
    """Per document one row with the sum over the head and, for each pre-token
    beyond it, one row with its frequency. ``h`` and ``n_bytes`` stand for the text."""

    def run(batches):
        import xxhash

        known = head.value
        for batch in batches:
            for part in slices(batch, "t"):
                h, n_bytes, total = [], [], []
                at, pre, n = [], [], []
                for i, text in enumerate(part.column("t").to_pylist()):
                    raw = text.encode()
                    h.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    n_bytes.append(len(raw))
                    count = 0
                    for token, freq in Counter(pre_tokens(text)).items():
                        pieces = known.get(token)
                        if pieces is None:
                            at.append(i)
                            pre.append(token)
                            n.append(freq)
                        else:
                            count += freq * pieces
                    total.append(count)
                docs, rows = len(h), pa.array(at, pa.int32())
                h, n_bytes = pa.array(h, pa.int64()), pa.array(n_bytes, pa.int64())
                key = part.column("k")
                yield record_batch({
                    "h": pa.concat_arrays([h, h.take(rows)]),
                    "n_bytes": pa.concat_arrays([n_bytes, n_bytes.take(rows)]),
                    "k": pa.concat_arrays([key, pa.nulls(len(at), key.type)]),
                    "is_doc": pa.array([True] * docs + [False] * len(at)),
                    # never a pre-token (those have no other space behind another character); spreads the document rows
                    "pre": pa.array([f"- {x} " for x in h.to_pylist()] + pre, pa.string()),
                    "n": pa.array(total + n, pa.int64())})

    return run


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text",
                 head_bytes: int = 48 << 20) -> DataFrame:
    """``key, n_bytes, n_tokens`` for every row of ``docs``."""
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")))
    vocab = written(vocabulary(rows, model_path, "t"))
    least, head = _head(vocab, head_bytes)
    kind = rows.schema["k"].dataType.simpleString()
    counted = map_batches(rows, _documents(spark.sparkContext.broadcast(head)),
                          f"h long, n_bytes long, k {kind}, is_doc boolean, pre string, n long")
    # per text: its documents, and once for all its copies the pieces beyond the head
    priced = written(counted.join(vocab.where(F.col("n") < least).select("pre", "pieces"), "pre", "left").groupBy(
        "h", "n_bytes", "k", "is_doc").agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("tokens")))
    own = priced.where("is_doc")
    more = priced.where("NOT is_doc").select("h", "n_bytes", F.col("tokens").alias("beyond")).join(
        own.groupBy("h", "n_bytes").agg(F.sum("copies").alias("docs")), ["h", "n_bytes"])
    out = own.join(more, ["h", "n_bytes"], "left").withColumn(
        "n_tokens", (F.col("tokens") / F.col("copies")).cast("long")
        + F.coalesce((F.col("beyond") / F.col("docs")).cast("long"), F.lit(0)))
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(F.col("k").alias(key), "n_bytes", "n_tokens")
