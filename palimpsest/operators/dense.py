"""Dense-vector operators: chunk embedding (V7) and exact top-1 cosine
matching within groups (J7 + J5).

Embedding runs in ``mapInPandas``: the embedder is built once per Python
worker and sees Arrow batches of texts; each text maps to one vector,
independent of the batch it lands in.

Matching is exact (every suspicious unit gets what comparing it with every source unit
of its group would give, as the reference's argmax does), but it never emits the pairs
as rows and never puts a whole group in one task: groups are cut into blocks of about
``block_rows`` units per side, every pair of blocks is one numpy matrix product, strip by strip, that
keeps only the best source per suspicious row, and a final ``max_by`` picks the best over a row's blocks.

Large groups do without most blocks where their vectors have structure. Sources go to the nearest of some of them (pivots, half of
them drawn at random, half by the squared angle to those); such a cell has a radius, the largest angle to its pivot. No source of a cell is nearer to a vector than
its angle to the pivot less that radius. A unit is first compared with the cell that could be nearest, and then only with
cells whose bound is no worse than what it has found.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.bestmatch import TIE_DECIMALS
from palimpsest.operators.sizing import measured, reused
from palimpsest.session import ship_package, text_partitions

_TOKEN = re.compile(r"\w+")


class HashingEmbedder:
    """Deterministic stand-in for a transformer: signed feature hashing of
    lower-cased word tokens, summed over the tokens of one text.

    Token -> bucket ``int(md5[:8], 16) % dim``, sign from the parity of
    ``int(md5[8:16], 16)``. The vector holds integer counts: mean pooling
    would only rescale it, which cosine ignores, and integers keep every dot
    product and norm exact (so any engine that computes md5 reproduces it).

    ``max_tokens`` keeps the first so many tokens of a text only, as encoders with a
    limited input do (the reference's takes 512); by default whole texts are embedded.

    Any object with ``embed(list[str]) -> np.ndarray[(n, dim)]`` and a
    ``dim`` attribute can replace it (e.g. an ONNX sentence encoder).
    """

    def __init__(self, dim: int = 256, max_tokens: int | None = None):
        self.dim, self.max_tokens = dim, max_tokens

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        cache: dict[str, tuple[int, float]] = {}
        for row, text in enumerate(texts):
            for tok in _TOKEN.findall((text or "").lower())[:self.max_tokens]:
                hit = cache.get(tok)
                if hit is None:
                    h = hashlib.md5(tok.encode("utf-8")).hexdigest()
                    hit = (int(h[:8], 16) % self.dim, 1.0 if int(h[8:16], 16) % 2 == 0 else -1.0)
                    cache[tok] = hit
                out[row, hit[0]] += hit[1]
        return out


def embed(df: DataFrame, text_col: str, embedder_factory=HashingEmbedder, *,
          out: str = "embedding") -> DataFrame:
    """V7: add ``out`` (array<float>) holding the embedding of ``text_col``.

    ``embedder_factory`` is called once per worker process and partition
    stream (not per row)."""
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        model = embedder_factory()
        for pdf in batches:
            vectors = model.embed(pdf[text_col].fillna("").tolist())
            pdf[out] = list(vectors.astype(np.float32))
            yield pdf

    return df.mapInPandas(run, schema)


#: Cells of a similarity matrix worked on at once.
STRIP = 1 << 21
#: Slack of the angle bound, so that rounding skips nothing that could win.
ANGLE_SLACK = 1e-6


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as unit rows in doubles; a zero vector stays zero."""
    n = len(column)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if n else np.zeros(0)
    x = flat.astype(np.float64).reshape(n, -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _strips(n: int, width: int):
    step = max(1, STRIP // max(1, width))
    return ((i, min(n, i + step)) for i in range(0, n, step))


def _table(schema: T.StructType, keys: dict, columns: dict[str, np.ndarray]) -> pa.Table:
    """Rows of one group: its key values beside the columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    n = len(next(iter(columns.values())))
    arrow = to_arrow_schema(schema)
    return pa.table([pa.array([keys[f.name]] * n if f.name in keys else columns[f.name], f.type) for f in arrow], schema=arrow)


def _top1(schema: T.StructType, group: list[str], exclude_self: bool):
    """Best source of each suspicious unit of a block, the lowest index of equals."""

    def run(sus: pa.Table, src: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if sus.num_rows and src.num_rows:
            own, idx = sus.column("_idx").to_numpy(), src.column("_idx").to_numpy()
            order = np.argsort(idx, kind="stable")
            a, b, idx = _unit(sus.column("_vec")), _unit(src.column("_vec"))[order], idx[order]
            for i, j in _strips(len(a), len(b)):
                sims = a[i:j] @ b.T
                if exclude_self:
                    sims[own[i:j, None] == idx[None, :]] = -np.inf
                best = np.argmax(np.round(sims, TIE_DECIMALS), axis=1)
                score = sims[np.arange(j - i), best]
                keep = np.isfinite(score)
                found.append((own[i:j][keep], idx[best][keep], score[keep]))
        sus_idx, src_idx, score = (np.concatenate(c) for c in zip(*found))
        some = sus if sus.num_rows else src
        keys = {g: some.column(g)[0].as_py() for g in group} if some.num_rows else {}
        return _table(schema, keys, {"sus_idx": sus_idx, "src_idx": src_idx, "similarity": score})

    return run


def _cogrouped(left: DataFrame, right: DataFrame, by: list[str], fn, schema: T.StructType) -> DataFrame:
    # an explicit partition count: adaptive coalescing would otherwise pack the (byte-small,
    # compute-heavy) blocks into very few Python tasks; named anew as both sides may come from one frame
    n = text_partitions(left.sparkSession)
    left, right = (x.repartition(n, *by).toDF(*x.columns) for x in (left, right))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(fn, schema)


def _in_blocks(sus: DataFrame, src: DataFrame, keys: list[str], group: list[str], block_rows: int, exclude_self: bool,
               schema: T.StructType) -> DataFrame:
    """Best source per suspicious unit within equal ``keys``: both sides are hashed into blocks of about
    ``block_rows`` and each pair of blocks is one task's matrix product."""
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    blocks = count(sus, "_sus").join(count(src, "_src"), keys)
    mine = lambda n: F.pmod(F.xxhash64("_idx"), F.col(n)).cast("int").alias(n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n)
    left = sus.join(blocks, keys).select(*keys, "_idx", "_vec", mine("_sus"), every("_src"))
    right = src.join(blocks, keys).select(*keys, "_idx", "_vec", mine("_src"), every("_sus"))
    return _cogrouped(left, right, [*keys, "_sus", "_src"], _top1(schema, group, exclude_self), schema)


def _assign(schema: T.StructType, group: list[str], carry: list[str]):
    """The nearest pivot of each unit (its cell) and the angle to it."""

    def run(units: pa.Table, pivots: pa.Table) -> pa.Table:
        keys = {g: units.column(g)[0].as_py() for g in group} if units.num_rows else {}
        if not units.num_rows or not pivots.num_rows:
            return _table(schema, keys, {c: np.zeros(0) for c in [*carry, "_cell", "_angle"]})
        order = np.argsort(pivots.column("_cell").to_numpy(), kind="stable")
        x, p = _unit(units.column("_vec")), _unit(pivots.column("_vec"))[order]
        cell, angle = np.zeros(len(x), np.int64), np.zeros(len(x))
        for i, j in _strips(len(x), len(p)):
            cos = x[i:j] @ p.T
            cell[i:j] = np.argmax(cos, axis=1)
            angle[i:j] = np.arccos(np.clip(cos[np.arange(j - i), cell[i:j]], -1, 1))
        columns = {"_idx": units.column("_idx").to_numpy(), "_vec": units.column("_vec").to_pylist(),
                   "_cell": pivots.column("_cell").to_numpy()[order][cell], "_angle": angle}
        return _table(schema, keys, {c: columns[c] for c in [*carry, "_cell", "_angle"]})

    return run


def _route(schema: T.StructType, group: list[str]):
    """The cells that can hold a source better than what a unit has found (``_least``): those
    whose nearest possible angle, to the pivot less the cell's radius, is small enough. Without a find yet, the one cell that could hold the best."""

    def run(units: pa.Table, cells: pa.Table) -> pa.Table:
        keys = {g: units.column(g)[0].as_py() for g in group} if units.num_rows else {}
        if not units.num_rows or not cells.num_rows:
            return _table(schema, keys, {"_idx": np.zeros(0), "_vec": [], "_cells": [], "_of": np.zeros(0)})
        x, p = _unit(units.column("_vec")), _unit(cells.column("_vec"))
        number, radius = cells.column("_cell").to_numpy(), cells.column("_radius").to_numpy()
        least, home = (units.column(c).to_numpy(zero_copy_only=False) for c in ("_least", "_home"))
        out: list[list[int]] = []
        for i, j in _strips(len(x), len(p)):
            nearest = np.maximum(np.arccos(np.clip(x[i:j] @ p.T, -1, 1)) - radius - ANGLE_SLACK, 0)
            for row, s, h in zip(nearest, least[i:j], home[i:j]):
                out.append([int(number[np.argmin(row)])] if h < 0 else number[(np.cos(row) >= s - 10.0 ** -TIE_DECIMALS) & (number != h)].tolist())
        return _table(schema, keys, {"_idx": units.column("_idx").to_numpy(), "_vec": units.column("_vec").to_pylist(), "_cells": out,
                                     "_of": np.full(len(x), len(number))})

    return run


def _pruned(sus: DataFrame, src: DataFrame, sizes: DataFrame, group: list[str], block_rows: int, max_cells: int, exclude_self: bool,
            schema: T.StructType, report: dict | None) -> DataFrame:
    """``_in_blocks`` for large groups, without the cells that the angle bound rules out (see module doc)."""
    spark, vec = sus.sparkSession, src.schema["_vec"].dataType
    kinds = [src.schema[g] for g in group]
    field = lambda name, kind: T.StructField(name, kind)
    zero = ~F.exists("_vec", lambda v: v != 0)  # pivots only if nothing else is left
    order = F.row_number().over(Window.partitionBy(*group).orderBy(zero, F.xxhash64("_idx"), "_idx"))
    half = F.least(F.lit(max_cells // 2), F.ceil(2 * F.col("_n") / block_rows)).cast("int")

    def drawn(rows: DataFrame, order: Column, first) -> DataFrame:
        return rows.join(sizes, group).withColumn("_cell", (order - 1).cast("long")).where(F.col("_cell") < half).select(
            *group, (F.col("_cell") + first).alias("_cell"), "_vec")

    def dealt(units: DataFrame) -> DataFrame:  # slices of a group, each with all its pivots
        return units.join(sizes.select(*group, F.ceil(F.col("_n") / (8 * block_rows)).cast("int").alias("_slices")), group).withColumn(
            "_slice", F.pmod(F.xxhash64("_idx"), F.col("_slices")).cast("int"))

    def copied(per_cell: DataFrame) -> DataFrame:
        return per_cell.join(sizes.select(*group, F.ceil(F.col("_n") / (8 * block_rows)).cast("int").alias("_slices")), group).withColumn(
            "_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))

    by = [*group, "_slice"]
    assigned = T.StructType([*kinds, field("_idx", T.LongType()), field("_vec", vec), field("_cell", T.LongType()), field("_angle", T.DoubleType())])
    pivots = reused(drawn(src, order, F.lit(0)))
    first_home = reused(_cogrouped(dealt(src), copied(pivots), by, _assign(assigned, group, ["_idx", "_vec"]), assigned))
    # as many again, drawn with chances by the squared angle to the first: regions without a pivot get one
    race = -F.log((F.pmod(F.xxhash64("_idx", F.lit(1)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))) / (F.col("_angle") * F.col("_angle") + 1e-9)
    order = F.row_number().over(Window.partitionBy(*group).orderBy(race, "_idx"))
    pivots = reused(pivots.unionByName(drawn(first_home, order, half)))
    home = reused(_cogrouped(dealt(src), copied(pivots), by, _assign(assigned, group, ["_idx", "_vec"]), assigned))
    radii = home.groupBy(*group, "_cell").agg(F.max("_angle").alias("_radius"))
    balls = reused(pivots.join(radii, [*group, "_cell"]))
    routed = T.StructType([*kinds, field("_idx", T.LongType()), field("_vec", vec), field("_cells", T.ArrayType(T.LongType())), field("_of", T.LongType())])

    def searched(units: DataFrame) -> tuple[DataFrame, DataFrame]:
        routes = reused(_cogrouped(dealt(units), copied(balls), by, _route(routed, group), routed))
        asked = routes.select(*group, "_idx", "_vec", F.explode("_cells").alias("_cell"))
        return routes, _in_blocks(asked, home.drop("_angle"), [*group, "_cell"], group, block_rows, exclude_self, schema)

    start = sus.withColumns({"_least": F.lit(-2.0), "_home": F.lit(-1).cast("long")})
    routes, first = searched(start)
    first = reused(first)
    of_first = first.select(*group, F.col("sus_idx").alias("_idx"), F.col("similarity").alias("_found"))
    again = routes.select(*group, "_idx", "_vec", F.col("_cells")[0].alias("_home")).join(of_first, [*group, "_idx"], "left").withColumn(
        "_least", F.coalesce("_found", F.lit(-2.0))).drop("_found")
    rest, second = searched(again)
    if report is not None:
        asked, of = rest.agg(F.sum(F.size("_cells") + 1), F.sum("_of")).first()
        report.update(cells_searched=asked or 0, cells=of or 0)
    return first.unionByName(second)


def dense_top1(sus: DataFrame, src: DataFrame, *, group: list[str], sus_idx: str, src_idx: str,
               vec: str = "embedding", block_rows: int = 4096, max_cells: int = 4096,
               exclude_self: bool = False, report: dict | None = None) -> DataFrame:
    """Best source unit per suspicious unit of each group by cosine of dense
    vectors. ``sus(group..., sus_idx, vec)``, ``src(group..., src_idx, vec)``;
    indexes are integers. Ties go to the lower source index; a zero vector
    has similarity 0 with everything. ``exclude_self`` skips pairs whose two
    indexes are equal (matching a set against itself). ``report`` is filled with the
    cells of large groups and those searched, summed over their suspicious units.

    Output ``(group..., sus_idx, src_idx, similarity)``, one row per
    suspicious unit whose group has at least one other source unit.
    """
    group = list(group)
    ship_package(sus.sparkSession)
    s = sus.select(*group, F.col(sus_idx).cast("long").alias("_idx"), F.col(vec).alias("_vec"))
    r = src.select(*group, F.col(src_idx).cast("long").alias("_idx"), F.col(vec).alias("_vec"))
    schema = T.StructType([*(r.schema[c] for c in group), T.StructField("sus_idx", T.LongType()),
                           T.StructField("src_idx", T.LongType()), T.StructField("similarity", T.DoubleType())])
    large = r.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * block_rows)
    large, n, _ = measured(large)  # at most a row per 2 * block_rows sources
    if n:
        pick = lambda df, how: df.join(F.broadcast(large.select(*group)), group, how)
        r_large = pick(r, "left_semi")
        if report is None:
            report = {}
        cells = _pruned(reused(pick(s, "left_semi")), reused(r_large), F.broadcast(large), group, block_rows, max_cells, exclude_self, schema, report)
        cells = cells.unionByName(_in_blocks(pick(s, "left_anti"), pick(r, "left_anti"), group, group, block_rows, exclude_self, schema))
    else:
        cells = _in_blocks(s, r, group, group, block_rows, exclude_self, schema)
    ranked = F.struct(F.round("similarity", TIE_DECIMALS), -F.col("src_idx"))
    best = (cells.groupBy(*group, "sus_idx")
            .agg(F.max_by(F.struct("src_idx", "similarity"), ranked).alias("b")))
    return best.select(*group, F.col("sus_idx").alias(sus_idx), F.col("b.src_idx").alias(src_idx),
                       F.col("b.similarity").alias("similarity"))
