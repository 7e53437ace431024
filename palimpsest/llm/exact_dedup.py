"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut where its content says so (a boundary pattern after a minimum
length), so equal texts have equal cuts. Every chunk travels once, after
its copies met in the map task, to be grouped under its 64-bit
hash: a hash that stands for one chunk text is a verified identifier; a hash that
stands for several gets one identifier for each text. From then on a
document is its ordered identifier list, a few longs, and lists are what is compared.

Defined cases: a null text counts as empty (all empty texts are equal, their
recipe is the empty list); a null key sorts below all others; rows repeated with the same key
stay separate rows, of which one is kept; an empty table gives an empty result;
only ``key`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, materialised, without

#: A chunk ends after a vowel, a consonant and white space once it has MIN_CHUNK
#: characters, at MAX_CHUNK at the latest.
MIN_CHUNK, MAX_CHUNK = 768, 4096


def chunk_texts(text: Column) -> Column:
    """The content-defined chunks of ``text``; concatenated they are the text."""
    return F.regexp_extract_all(
        text, F.lit(rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[aeiou][a-z]\s|.{{1,{MAX_CHUNK}}}"), F.lit(0))


def _chunked(docs: DataFrame, key: str, text: str) -> DataFrame:
    norm = docs.select(F.col(key).alias("k"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return norm.select("k", "t", chunk_texts(F.col("t")).alias("chunks"))


def colliding_chunks(chunks: DataFrame) -> DataFrame | None:
    """``(h, c, variant)`` for chunk texts whose hash also stands for another text;
    none where every hash stands for one text. Texts travel once, to be compared;
    only those of the clashing hashes travel again."""
    distinct = chunks.select("h", "c").distinct()
    many = materialised(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    if many.isEmpty():
        return None
    rank = F.row_number().over(Window.partitionBy("h").orderBy("c"))
    return materialised(chunks.join(many, "h", "left_semi").distinct().withColumn("variant", rank))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text",
                chunk_hash=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id`` (largest key of the equal
    texts), ``group_size``, ``kept``, ``text_sha256`` and ``n_chunks``."""
    cut = _chunked(docs, key, text)
    chunks = cut.select(F.explode("chunks").alias("c")).select(chunk_hash(F.col("c")).alias("h"), "c")
    clash = colliding_chunks(chunks)
    recipe = cut.select("k", F.sha2("t", 256).alias("sha"), "chunks",
                        F.transform("chunks", lambda c: chunk_hash(c)).alias("ids"))
    plain = recipe.select("k", "sha", "ids", F.lit("").alias("variants"))
    if clash is not None:
        plain = _with_variants(recipe, clash, chunk_hash)
    rows = materialised(plain.groupBy("ids", "variants", "k", "sha").agg(F.count(F.lit(1)).alias("n")))
    groups = rows.groupBy("ids", "variants").agg(
        F.max("k").alias("keep_id"), F.sum("n").alias("group_size"))
    same = (F.col("r.ids") == F.col("g.ids")) & (F.col("r.variants") == F.col("g.variants"))
    each = rows.alias("r").join(groups.alias("g"), same).select(
        "k", "keep_id", "group_size", "sha", F.size("r.ids").cast("long").alias("n_chunks"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return each.select(F.col("k").alias(key), "keep_id", "group_size",
                       (F.col("k").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                       F.col("sha").alias("text_sha256"), "n_chunks")


def _with_variants(recipe: DataFrame, clash: DataFrame, chunk_hash) -> DataFrame:
    """Recipes with the variants of their clashing chunks, in order. Rows without
    such chunks are told apart by a join on the few clashing hashes alone."""
    row = recipe.withColumn("row", F.struct("k", "sha", "ids"))
    pos = row.select("row", F.posexplode_outer("chunks").alias("pos", "c")).select(
        "row", "pos", "c", chunk_hash(F.col("c")).alias("h"))
    # distinct: rows repeated with the same key have the same chunks; counted below
    hit = pos.join(clash, ["h", "c"]).select("row", "pos", "variant").distinct()
    found = hit.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "variant"))).alias("v"))
    return row.alias("a").join(found.alias("b"), F.col("a.row").eqNullSafe(F.col("b.row")), "left").select(
        "a.k", "a.sha", "a.ids", F.coalesce(F.col("v").cast("string"), F.lit("")).alias("variants"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that stay: of equal texts the one with the largest key."""
    by_row = materialised(exact_dedup(docs, key, text).groupBy(F.col(key).alias("k"), "text_sha256").agg(
        F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256)
    same = {"k": F.col(key), "text_sha256": sha}
    out = without(docs, by_row.where("NOT stays"), same)
    repeated = by_row.where("stays AND n > 1")
    if repeated.isEmpty():
        return out
    # rows repeated with key and text: one of them
    k, s = f"_{uuid.uuid4().hex}", f"_{uuid.uuid4().hex}"
    marked = out.withColumns({k: F.col(key), s: sha})
    twice = repeated.select(F.col("k").alias(k + "r"), F.col("text_sha256").alias(s + "r"))
    once = marked.join(twice, F.col(k).eqNullSafe(F.col(k + "r")) & (F.col(s) == F.col(s + "r")), "left_semi")
    return without(out, repeated, same).unionByName(once.dropDuplicates([k, s]).drop(k, s))
