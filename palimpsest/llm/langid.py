"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get one probability per language. The
probability of a word is the sum over all its segmentations into pieces,
computed by the forward algorithm; a text is the product over its words (runs of
letters, lower-cased, with the vocabulary's word-start mark in front), and the
language with the highest posterior under equal priors is predicted.

Probabilities are learned by expectation maximisation: the words of labelled rows are counted
per language, forward-backward passes over the distinct words give expected
piece counts, summed by Spark, and a backing-off to the pooled counts
smooths them. At most ``sample_rows`` distinct labelled rows per language are used for
that (drawn by a hash of key and text); every text is scored whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; a
null key or label is not learned from; no labelled row at all makes every text ``und``; rows
repeated are scored each; an empty table gives an empty result; only ``key``, ``text``
and ``lang`` are read, and ``lang`` only for learning.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, materialised, record_batch, slices, spread, without

MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
MAX_PIECE = 16  # characters of the longest piece looked up
FLOOR = 1e-7  # probability of any single character that is no piece
MAX_CACHED = 120_000
_VOCAB: dict = {}
_TRIES: dict = {}


def vocabulary(path: str) -> dict[str, int]:
    """Piece -> row of the probability table; row 0 is the unknown character."""
    if path not in _VOCAB:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        _VOCAB[path] = {p: i + 1 for i, p in enumerate(pieces) if len(p) <= MAX_PIECE}
    return _VOCAB[path]


class Trie:
    """The pieces as a trie in arrays, for steps of many nodes at once.

    ``edges`` holds ``node << 21 | code point`` in order, ``to`` the node each leads to (one more node, without
    edges, where there is none), ``row`` the table row of the piece that ends at a node (-1: none does)."""

    def __init__(self, vocab: dict[str, int]):
        nodes = {"": 0}
        for piece in vocab:
            for j in range(1, len(piece) + 1):
                nodes.setdefault(piece[:j], len(nodes))
        found = sorted((nodes[x[:-1]] << 21 | ord(x[-1]), node) for x, node in nodes.items() if x)
        self.nowhere = len(nodes)
        self.edges = np.array([e for e, _ in found] + [np.iinfo(np.int64).max], np.int64)
        self.to = np.array([node for _, node in found] + [self.nowhere], np.int64)
        self.row = np.full(len(nodes) + 1, -1, np.int64)
        self.row[[nodes[x] for x in vocab]] = list(vocab.values())
        self.first = np.full(sys.maxunicode + 1, self.nowhere, np.int32)  # from the root, by code point
        for x, node in nodes.items():
            if len(x) == 1:
                self.first[ord(x)] = node

    def step(self, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
        edges = nodes << 21 | points
        at = np.searchsorted(self.edges, edges)
        return np.where(self.edges[at] == edges, self.to[at], self.nowhere)


def trie(path: str) -> Trie:
    if path not in _TRIES:
        _TRIES[path] = Trie(vocabulary(path))
    return _TRIES[path]


def forward(words: list[str], vocab: dict[str, int] | Trie, theta: np.ndarray) -> np.ndarray:
    """Log-probability (words x languages) of words of one length, summed over all
    segmentations. ``theta`` has a zero row at its end, which -1 picks.

    The places in the trie that the pieces begun so far have come to move on together, character by
    character; a place without a piece that goes on is dropped."""
    pieces = vocab if isinstance(vocab, Trie) else Trie(vocab)
    n, m, langs = len(words), len(words[0]), theta.shape[1]
    points = np.array(words).view(np.uint32).reshape(n, m)
    columns = np.ascontiguousarray(theta.T)
    alpha = np.zeros((langs, MAX_PIECE + 1, n))  # of the last ends, by their remainder
    alpha[:, 0] = 1.0
    flat = alpha.reshape(langs, -1)
    scale = np.zeros((langs, n))
    every = np.arange(n)
    word, start, node = (np.zeros(0, np.int64) for _ in range(3))
    for j in range(1, m + 1):
        now = points[:, j - 1].astype(np.int64)
        begun, node = pieces.first[now].astype(np.int64), pieces.step(node, now[word])
        row = np.concatenate([pieces.row[node], np.maximum(pieces.row[begun], 0)])  # a single character that is no piece: row 0
        word, start, node = (np.concatenate(x) for x in ((word, every), (start, np.full(n, j - 1)), (node, begun)))
        ends = np.flatnonzero(row >= 0)
        at, row = word[ends], row[ends]
        before = start[ends] % (MAX_PIECE + 1) * n + at
        # starts come in order, so every sum is taken in the order of the starts
        total = np.stack([np.bincount(at, flat[x][before] * columns[x][row], n) for x in range(langs)])
        alpha[:, j % (MAX_PIECE + 1)] = total
        if j % MAX_PIECE == 0:  # keep long words away from underflow
            for i in range(j - MAX_PIECE + 1, j + 1):
                alpha[:, i % (MAX_PIECE + 1)] /= total
            scale += np.log(total)
        on = np.flatnonzero((node != pieces.nowhere) & (start > j - MAX_PIECE))
        word, start, node = word[on], start[on], node[on]
    return (np.log(alpha[:, m % (MAX_PIECE + 1)]) + scale).T


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


# ------------------------------------------------------------------ learning

def _word_rows(batches):
    for batch in batches:
        for part in slices(batch, "t"):
            lang, word = [], []
            for name, text in zip(part.column("lang").to_pylist(), part.column("t").to_pylist()):
                found = words_of(text)
                lang += [name] * len(found)
                word += found
            yield record_batch({"lang": pa.array(lang, pa.string()), "word": pa.array(word, pa.string())})


def _expected(path: str, langs: list[str], theta):
    """Expected piece counts of ``(lang, word, n)`` rows under ``theta``."""

    def run(batches):
        vocab, table, at = vocabulary(path), theta.value, {x: i for i, x in enumerate(langs)}
        sums = np.zeros((len(table) - 1, len(langs)))
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                word, col = MARK + word, at[lang]
                m = len(word)
                arcs = [(i, j, vocab.get(word[i:j], 0 if j - i == 1 else -1))
                        for j in range(1, m + 1) for i in range(max(0, j - MAX_PIECE), j)]
                arcs = [(i, j, r, table[r, col]) for i, j, r in arcs if r >= 0]
                alpha, beta = [1.0] + [0.0] * m, [0.0] * m + [1.0]
                for i, j, _, p in arcs:
                    alpha[j] += alpha[i] * p
                if not alpha[m] > 1e-280:
                    continue  # too long for plain arithmetic; junk rather than a word
                for i, j, _, p in sorted(arcs, key=lambda a: -a[1]):
                    beta[i] += beta[j] * p
                for i, j, r, p in arcs:
                    sums[r, col] += n * alpha[i] * p * beta[j] / alpha[m]
        r, c = np.nonzero(sums)
        yield record_batch({"piece": pa.array(r, pa.int32()), "lang": pa.array(c.astype(np.int32), pa.int32()),
                            "n": pa.array(sums[r, c], pa.float64())})

    return run


def fit(train: DataFrame, vocab_path: str, sample_rows: int = 500, steps: int = 4, backoff: float = 200.0,
        key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the table of piece probabilities (pieces x languages, a zero row last)."""
    spark = train.sparkSession
    rows = train.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # one number per language
    size = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(size)
    if not langs:
        return [], np.zeros((1, 0))
    # drawn by key and text, so that a repeated key is many draws; a repeated row is one
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    share = F.lit(0.0)
    for name, n in size.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 2 * sample_rows / n))).otherwise(share)
    drawn = rows.where(F.pmod(F.col("h"), F.lit(1 << 20)) < share * (1 << 20)).groupBy("lang", "h").agg(F.first("t").alias("t"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = spread(drawn.withColumn("order", order).where(F.col("order") <= sample_rows).select("lang", "t"))
    words = materialised(map_batches(sample, _word_rows, "lang string, word string").groupBy("lang", "word").agg(
        F.count(F.lit(1)).alias("n")))
    n_pieces = len(vocabulary(vocab_path)) + 1
    # start: public order of the pieces, most useful first
    prior = 1.0 / (np.arange(n_pieces) + 20.0)
    table = np.tile((prior / prior.sum())[:, None], (1, len(langs)))
    for _ in range(steps):
        table[0] = FLOOR
        theta = spark.sparkContext.broadcast(np.vstack([table, np.zeros((1, len(langs)))]))
        got = map_batches(words, _expected(vocab_path, langs, theta), "piece int, lang int, n double").groupBy(
            "piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # at most pieces x languages
        counts = np.zeros((n_pieces, len(langs)))
        counts[got["piece"], got["lang"]] = got["n"]
        pooled = counts.sum(axis=1) + 0.01
        pooled /= pooled.sum()
        table = (counts + backoff * pooled[:, None]) / (counts.sum(axis=0) + backoff)
        table = np.maximum(table, 1e-12)
        theta.unpersist()
    table[0] = FLOOR
    return langs, np.vstack([table, np.zeros((1, len(langs)))])


# ------------------------------------------------------------------- scoring

def _predict(path: str, langs: list[str], theta):
    def run(batches):
        pieces, table = trie(path), theta.value
        known: dict[str, int] = defaultdict()  # word -> row of its scores; a new word gets the next
        known.default_factory = known.__len__
        scores = np.zeros((0, len(langs)))
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                if len(known) > MAX_CACHED:
                    known.clear()
                    scores = np.zeros((0, len(langs)))
                texts = [np.fromiter(map(known.__getitem__, words_of(t) if t and langs else []), np.int64)
                         for t in part.column("t").to_pylist()]
                new = list(islice(known, len(scores), None))
                lengths = np.fromiter(map(len, new), np.int64, len(new))
                found = np.zeros((len(new), len(langs)))
                for length in np.unique(lengths):
                    group = np.flatnonzero(lengths == length)
                    for i in range(0, len(group), 20_000):
                        chunk = group[i:i + 20_000]
                        found[chunk] = forward([MARK + new[x] for x in chunk], pieces, table)
                scores = np.concatenate([scores, found])
                pred, score = [], []
                for words in texts:
                    if not len(words):
                        pred.append("und")
                        score.append(0.0)
                        continue
                    total = scores[words].sum(axis=0)
                    best = int(np.argmax(total))
                    pred.append(langs[best])
                    score.append(float(1.0 / np.exp(total - total[best]).sum()))
                yield record_batch({"k": part.column("k"), "lang_pred": pa.array(pred, pa.string()),
                                    "score": pa.array(score, pa.float64())})

    return run


def predict(docs: DataFrame, vocab_path: str, model: tuple[list[str], np.ndarray], key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` for every row."""
    langs, table = model
    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = rows.schema["k"].dataType.simpleString()
    theta = docs.sparkSession.sparkContext.broadcast(table)
    return map_batches(rows, _predict(vocab_path, langs, theta), f"k {kind}, lang_pred string, score double") \
        .withColumnRenamed("k", key)


def keep_known(docs: DataFrame, vocab_path: str, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that have a language: all but those predicted ``und``.

    Only a digest of the text and the prediction come back from Python; the texts without a language, by
    their digests, are taken from ``docs`` where they are."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    unknown = predict(docs.select(digest.alias("k"), F.col(text).alias("t")), vocab_path, model, "k", "t").where("lang_pred = 'und'")
    return without(docs, unknown.select("k").distinct(), {"k": digest})


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the key as text is 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
