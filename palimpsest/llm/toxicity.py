"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the bag of its hashed character n-grams (and itself); its vector is the
mean of theirs, a segment of ``SEGMENT`` words the mean of its words' vectors, and a
two-class softmax is linear in that. Embeddings and softmax are trained together
in numpy by gradient descent, so a misspelt word that was never seen still
shares the vectors of its n-grams. Labels belong to documents: of a toxic
document the segment that looks most toxic carries the label in each round, of a clean
one all do. A document scores as its most toxic segment, calibrated on the training documents.

As all of it is linear, scoring needs one number per distinct word.

The training sample is bounded: at most about ``sample_rows`` labelled documents of
either label, drawn by a hash of the key, with at most ``max_segments`` segments for
either label (or one of each document). If there are more, the longest documents give distinct
segments, drawn by hash, up to one bound for all; rows of one key are one document. Every text is scored whole.

Defined cases: a null or empty text, or one without a word, has no segment and scores
as the bias alone; null keys and labels are not learned from; without both labels every score is 0;
rows repeated are scored each; an empty table gives an empty result; only
``key`` and ``text`` of the documents are read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, materialised, record_batch, slices, spread

WORD = re.compile(r"[^\W_]+")
SEGMENT, DIM, BUCKETS, GRAMS = 8, 4, 1 << 18, (3, 4, 5)
MAX_WORD = 40  # longer words are bags of the n-grams of all their MAX_WORD-character parts
MAX_CACHED = 300_000


def units(word: str) -> list[int]:
    """Buckets of the word and its character n-grams, with borders marked."""
    marked = f"<{word}>"
    out = [zlib.crc32(marked.encode()) % BUCKETS]
    for n in GRAMS:
        out += [zlib.crc32(marked[i:i + n].encode()) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def words_of(text: str | None) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    if found and max(map(len, found)) > MAX_WORD:
        found = [w[i:i + MAX_WORD] for w in found for i in range(0, len(w), MAX_WORD)]
    return found


@dataclass
class Model:
    """One number per bucket (its embedding projected on the softmax), the bias,
    and the calibration ``scale * logit + shift`` of a document's largest logit."""

    weight: np.ndarray
    bias: float
    scale: float
    shift: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        bags = [units(w) for w in words]
        flat = np.fromiter((u for b in bags for u in b), np.int64)
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        sums = np.add.reduceat(self.weight[flat], starts)
        return sums / np.array([len(b) for b in bags])

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))


# ------------------------------------------------------------------ learning

def _segments(batches):
    for batch in batches:
        for part in slices(batch, "t"):
            doc, label, words = [], [], []
            for d, y, text in zip(*(part.column(c).to_pylist() for c in ("doc", "label", "t"))):
                found = words_of(text)
                for i in range(0, len(found), SEGMENT):
                    doc.append(d)
                    label.append(y)
                    words.append(" ".join(found[i:i + SEGMENT]))
            yield record_batch({"doc": pa.array(doc, part.schema.field("doc").type), "label": pa.array(label, pa.int32()),
                                "words": pa.array(words, pa.string())})


class _Bags:
    """Segments as sparse sums over distinct words and those over buckets."""

    def __init__(self, segments: list[str], docs: np.ndarray, min_docs: int):
        ids: dict[str, int] = {}
        flat = [ids.setdefault(w, len(ids)) for s in segments for w in s.split(" ")]
        lens = np.array([s.count(" ") + 1 for s in segments])
        self.word, self.n = np.array(flat), len(segments)
        self.seg = np.repeat(np.arange(self.n), lens)
        self.per_seg = 1.0 / lens[self.seg]
        bags = [units(w) for w in ids]
        sizes = np.array([len(b) for b in bags])
        unit = np.fromiter((u for b in bags for u in b), np.int64)
        of_word = np.repeat(np.arange(len(bags)), sizes)
        self.n_words = len(bags)
        # a unit of few documents could only be learned by heart: its vector stays zero
        held = np.unique(np.c_[self.word, docs[self.seg]], axis=0)
        per_word = np.bincount(held[:, 0], minlength=self.n_words)
        docs_of = np.bincount(unit, per_word[of_word], BUCKETS)
        kept = docs_of[unit] >= min_docs
        self.used, self.unit = np.unique(unit[kept], return_inverse=True)
        self.of_word = of_word[kept]
        self.per_word = 1.0 / sizes[self.of_word]

    def vectors(self, emb):
        w = np.stack([np.bincount(self.of_word, emb[self.unit, d] * self.per_word, self.n_words)
                      for d in range(DIM)], 1)
        return np.stack([np.bincount(self.seg, w[self.word, d] * self.per_seg, self.n) for d in range(DIM)], 1)

    def gradient(self, grad):
        w = [np.bincount(self.word, grad[self.seg, d] * self.per_seg, self.n_words) for d in range(DIM)]
        return np.stack([np.bincount(self.unit, w[d][self.of_word] * self.per_word, len(self.used))
                         for d in range(DIM)], 1)


def train(docs: np.ndarray, labels: np.ndarray, segments: list[str], warm: int = 15, steps: int = 60,
          rate: float = 0.1, decay: float = 1e-5, min_docs: int = 6) -> Model:
    """Adam on the whole sample, first on all segments, then on each document's most
    toxic segment (chosen anew at every step) and, by a part, all segments of clean documents."""
    docs = np.unique(docs, return_inverse=True)[1]  # keys of any type
    bags, rng = _Bags(segments, docs, min_docs), np.random.default_rng(7)
    emb = rng.normal(0, 0.1, (len(bags.used), DIM))
    soft, bias = rng.normal(0, 0.1, (2, DIM)), np.zeros(2)
    order = np.lexsort((np.arange(len(docs)), docs))
    first = np.flatnonzero(np.r_[True, docs[order][1:] != docs[order][:-1]])
    n_of = np.diff(np.r_[first, len(docs)])
    doc_label = labels[order][first]
    n_toxic, n_clean = max(1, doc_label.sum()), max(1, (1 - doc_label).sum())
    every = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, soft, bias)]
    for step in range(1, warm + steps + 1):
        x = bags.vectors(emb)
        z = x @ soft.T + bias
        logit = z[:, 1] - z[:, 0]
        top = np.maximum.reduceat(logit[order], first)
        share = every
        if step > warm:
            is_top = np.zeros(len(docs), bool)
            is_top[order] = logit[order] == np.repeat(top, n_of)
            share = is_top * np.where(labels == 1, 0.5 / n_toxic, 0.35 / n_clean) + 0.3 * every * (labels == 0)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), labels] -= 1
        dz = p * share[:, None]
        grads = (bags.gradient(dz @ soft) + decay * emb, dz.T @ x, dz.sum(0))
        for value, grad, (m, v) in zip((emb, soft, bias), grads, state):
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.98 ** step)) + 1e-9)
    logit = bags.vectors(emb) @ (soft[1] - soft[0]) + (bias[1] - bias[0])
    weight = np.zeros(BUCKETS)
    weight[bags.used] = emb @ (soft[1] - soft[0])
    scale, shift = _calibrate(np.maximum.reduceat(logit[order], first), doc_label)
    return Model(weight, float(bias[1] - bias[0]), scale, shift)


def _calibrate(logit: np.ndarray, label: np.ndarray, penalty: float = 0.01) -> tuple[float, float]:
    """One-dimensional logistic regression by Newton steps, both labels weighing alike."""
    mid, width = logit.mean(), logit.std() + 1e-9
    x = np.c_[(logit - mid) / width, np.ones(len(logit))]
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    b = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([penalty, 1e-9]) * 0.1
        b -= np.linalg.solve(h, x.T @ (weight * (p - label)) + np.array([penalty * 0.1 * b[0], 0]))
    return float(b[0] / width), float(b[1] - b[0] * mid / width)


def _bound(sizes: list[int], total: int) -> int:
    """The highest bound, 1 at least, for which sizes cut to it sum to ``total`` at most."""
    left = total
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return max(1, left // (len(sizes) - i))
        left -= n
    return max(sizes, default=1)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 1000, max_segments: int = 80_000,
        key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """The model from the labelled rows of ``labels`` (none without both labels)."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(key).alias("doc")).agg(F.max((F.col(label) == 1).cast("int")).alias("label"))
    size = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return None
    drawn = F.pmod(F.xxhash64("doc"), F.lit(1 << 30))
    chosen = F.lit(False)
    for y, n in size.items():
        chosen = chosen | ((F.col("label") == y) & (drawn < min(1.0, sample_rows / n) * (1 << 30)))
    few = F.broadcast(known.where(chosen))  # about 2 x sample_rows ids
    sample = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).join(few, "doc").select(
        "doc", "label", "t")
    kind = sample.schema["doc"].dataType.simpleString()
    seg = materialised(map_batches(sample, _segments, f"doc {kind}, label int, words string"))  # read three times
    # long documents give way first: the highest bound of a document's segments that keeps either label
    # within max_segments, but a segment of every document
    sizes = seg.groupBy("label", "doc").agg(F.count(F.lit(1)).alias("n")).collect()  # about 2 x sample_rows
    bound = {y: _bound([r["n"] for r in sizes if r["label"] == y], max_segments) for y in size}
    if len({r["label"] for r in sizes}) < 2:
        return None
    long = [(r["doc"], bound[r["label"]]) for r in sizes if r["n"] > bound[r["label"]]]
    if long:
        over = F.broadcast(docs.sparkSession.createDataFrame(long, f"doc {kind}, bound long"))
        order = Window.partitionBy("doc").orderBy(F.xxhash64("doc", "words"), "words")
        cut = seg.join(over, "doc").distinct().withColumn("at", F.row_number().over(order)).where(
            F.col("at") <= F.col("bound")).select("doc", "label", "words")
        seg = seg.join(over, "doc", "left_anti").unionByName(cut)
    rows = seg.toPandas().sort_values(["doc", "words"], ignore_index=True)
    return train(rows["doc"].to_numpy(), rows["label"].to_numpy(), rows["words"].tolist())


# ------------------------------------------------------------------- scoring

def _score(model):
    def run(batches):
        m = model.value
        known: dict[str, int] = {}
        scores = np.zeros(0)
        for batch in batches:
            for part in slices(batch, "t"):
                texts = [words_of(t) for t in part.column("t").to_pylist()]
                if len(known) > MAX_CACHED:
                    known, scores = {}, np.zeros(0)
                new = list({w for words in texts for w in words if w not in known})
                if new:
                    scores = np.concatenate([scores, m.word_scores(new)])
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                best = np.full(len(texts), m.bias)
                for i, words in enumerate(texts):
                    if words:
                        s = scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
                        cuts = np.arange(0, len(s), SEGMENT)
                        sums = np.add.reduceat(s, cuts)
                        best[i] = (sums / np.diff(np.r_[cuts, len(s)])).max() + m.bias
                yield record_batch({"k": part.column("k"), "score": pa.array(m.probability(best), pa.float64())})

    return run


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted`` for every row."""
    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = rows.schema["k"].dataType.simpleString()
    if model is None:
        out = rows.select("k", F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        out = map_batches(rows, _score(shared), f"k {kind}, score double")
    return out.select(F.col("k").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the key as text is a multiple of 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))
