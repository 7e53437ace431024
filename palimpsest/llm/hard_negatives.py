"""Hard-negative mining by slot-decomposed selection.

A row's score for an anchor is the inner product of their vectors, each component taken
as floor(scale * x): whole numbers, so ties are exact. The anchor's positives are its
best rows of the same label. Each positive has a window of scores, ``low`` to ``high``
hundredths of its own score, and wants the first ``negatives`` rows of another label in it.
The windows of an anchor overlap, so one row would be looked at once for each.
Instead the upper limits of the windows, in falling order, cut the scores
into disjoint slots, slot i from limit i down to above limit i+1:

1. each block of rows keeps, for each anchor and slot, its first ``negatives`` rows (a
   combiner: a row falls into one slot only, and at most that many of a slot are of use);
2. these are merged per anchor and slot;
3. from the lowest slot up, a slot's rows in front of the list so far, cut to ``negatives``,
   are the first rows at or below that slot's limit. These suffix lists answer all windows:
   a window is the list of its own limit without what lies below its lower limit.

Anchors meet rows in blocks (``vectors.in_blocks``), once within their label for the
positives and once over all rows.

Defined cases: rows with a null id, label or vector, an empty vector or a component that is null
or not finite take no part; vectors of different lengths do not meet; repeated rows stand each
for themselves, also as each other's positives, an anchor excludes only its own row, and equal
scores go by id; a positive with a score below zero has an empty window; an anchor without
positives has no rows; an empty table gives no rows; scores beyond 2^53 either way are held there;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.vectors import at_least, best, in_blocks, matrix, numbered, numpy_of, strips

EXACT = 2.0**53
FOUND = "a_rid long, slot int, score long, id long, rid long"


def whole_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers held in doubles, exact up to 2^53."""
    if not len(a) or not len(b) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = [[sum(x * y for x, y in zip(p, q)) for q in ([int(v) for v in r] for r in b)] for p in ([int(v) for v in r] for r in a)]
    return np.array([[min(max(s, -int(EXACT)), int(EXACT)) for s in row] for row in exact], np.int64)


def _table(found: list[tuple[np.ndarray, ...]]) -> pa.Table:
    columns = [np.concatenate(c) if found else np.array([], np.int64) for c in zip(*found)] if found else [np.array([], np.int64)] * 5
    names = ("a_rid", "slot", "score", "id", "rid")
    return pa.table({n: pa.array(c, pa.int32() if n == "slot" else pa.int64()) for n, c in zip(names, columns)})


def _blocks(anchors: pa.Table, rows: pa.Table, scale: float):
    """Scores strip by strip: an anchor's place, its row of scores, and the rows' ids and numbers in id order."""
    rid, ident = numpy_of(rows, "rid"), numpy_of(rows, "id")
    order = np.lexsort((rid, ident))
    a, b = np.floor(scale * matrix(anchors.column("vec"))), np.floor(scale * matrix(rows.column("vec")))[order]
    for i, j in strips(len(a), len(b)):
        for at, row in zip(range(i, j), whole_scores(a[i:j], b)):
            yield at, row, ident[order], rid[order], order


def _positives(k: int, scale: float):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found, own = [], numpy_of(anchors, "rid")
        if anchors.num_rows and rows.num_rows:
            for at, score, ident, rid, _ in _blocks(anchors, rows, scale):
                other = np.flatnonzero(rid != own[at])
                keep = other[at_least(score[other], k)]
                keep = keep[np.argsort(-score[keep], kind="stable")[:k]]
                n = len(keep)
                found.append((np.full(n, own[at]), np.zeros(n, np.int64), score[keep], ident[keep], rid[keep]))
        return _table(found)

    return run


def _slots(k: int, scale: float):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            own, limits = numpy_of(anchors, "rid"), anchors.column("high").to_pylist()
            least, mine = numpy_of(anchors, "least"), anchors.column("label").to_pylist()
            codes: dict = {}
            label = np.array([codes.setdefault(v, len(codes)) for v in rows.column("label").to_pylist()])
            for at, score, ident, rid, order in _blocks(anchors, rows, scale):
                high = np.array(limits[at], np.int64)
                use = np.flatnonzero((score <= high[0]) & (score >= least[at]) & (label[order] != codes.get(mine[at], -1)))
                # slot: the last limit at or above the score
                slot = len(high) - 1 - np.searchsorted(high[::-1], score[use])
                for s in np.unique(slot):
                    keep = use[slot == s]
                    keep = keep[at_least(score[keep], k)]
                    keep = keep[np.argsort(-score[keep], kind="stable")[:k]]
                    n = len(keep)
                    found.append((np.full(n, own[at]), np.full(n, s), score[keep], ident[keep], rid[keep]))
        return _table(found)

    return run


def mine(rows: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, block: int = 8192) -> DataFrame:
    """``anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score``: for each
    anchor and positive the first ``negatives`` rows of another label with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``."""
    base = numbered(rows.where(F.col(label).isNotNull()), id, vector, label=F.col(label).cast("string"), anchor=is_anchor)
    anchors = base.where("anchor").drop("anchor")
    same = best(in_blocks(base, anchors, ["dim", "label"], block, _positives(positives, scale), FOUND), ["a_rid"], positives)
    # whole numbers: upper limit rounded down, lower limit up
    up = F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100")
    down = F.expr(f"-((-score * {low} - pmod(-score * {low}, 100)) div 100)")
    chosen = same.select("a_rid", "rank", F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                                                   up.alias("high"), down.alias("low")).alias("p"))
    chosen = chosen.groupBy("a_rid").agg(F.sort_array(F.collect_list("p")).alias("ps"))  # at most ``positives`` each
    asked = anchors.join(chosen.withColumnRenamed("a_rid", "rid"), "rid").select(
        "rid", "id", "vec", "dim", "label", F.col("ps.high").alias("high"), F.array_min("ps.low").alias("least"), "ps")
    slots = best(in_blocks(base.drop("anchor"), asked.drop("ps", "id"), ["dim"], block, _slots(negatives, scale), FOUND),
                 ["a_rid", "slot"], negatives)
    kept = slots.groupBy("a_rid").agg(  # at most ``positives * negatives`` each
        F.array_sort(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("found"))
    lists = F.aggregate(  # suffix lists, lowest slot first
        F.sequence(F.size("ps") - 1, F.lit(0), F.lit(-1)), F.expr("cast(array() as array<array<struct<slot:int,rank:int,id:bigint,score:bigint>>>)"),
        lambda lists, s: F.concat(lists, F.array(F.slice(F.concat(F.filter("found", lambda f: f["slot"] == s), F.coalesce(
            F.try_element_at(lists, F.lit(-1)), F.expr("cast(array() as array<struct<slot:int,rank:int,id:bigint,score:bigint>>)"))), 1, negatives))))
    answers = asked.select(F.col("rid").alias("a_rid"), F.col("id").alias("anchor_id"), "ps").join(kept, "a_rid").select(
        "anchor_id", F.posexplode("ps").alias("i", "p"), F.reverse(lists).alias("lists"))
    # an ``_outer`` generator, so that the windows are not worked out a second time for a filter
    out = answers.select("anchor_id", "p", F.posexplode_outer(F.filter(
        F.col("lists")[F.col("i")], lambda f: f["score"] >= F.col("p.low"))).alias("at", "f")).where(F.col("f").isNotNull())
    return out.select("anchor_id", F.col("p.positive_id").alias("positive_id"), F.col("p.rank").alias("positive_rank"),
                      (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("negative_id"),
                      F.col("p.positive_score").alias("positive_score"), F.col("f.score").alias("negative_score"))
