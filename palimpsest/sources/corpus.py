"""Labelled corpus ingest (S1-S7, C5) from a directory tree:

    <root>/external-detection-corpus/source-document/part*/<id>.txt  (+ <id>.xml)
    <root>/external-detection-corpus/suspicious-document/part*/<id>.txt  (+ <id>.xml)

``load_corpus`` reads it by the data source of ``sources.labelled`` or, with ``reader='jvm'``, as follows. Text files are read by the ``binaryFile`` source (executors read the files;
content is decoded on the JVM) and truth sidecars by the built-in XML source
with ``rowTag=feature``, which yields every ``feature`` element at any depth.
Sidecar rows are folded into one metadata struct per file with aggregates;
nothing is collected to the driver except, for a capped sample, the bounded
list of sampled paths.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.prepare import prepare_documents
from palimpsest.operators.sizing import broadcast_if_bounded
from palimpsest.schemas import ANNOTATION_TYPE, METADATA_TYPE

BASE = "external-detection-corpus"
SIDES = {"source": "source-document", "suspicious": "suspicious-document"}

# Attribute defaults of the truth sidecar format.
DEFAULT_LANGUAGE = "unknown"
DEFAULT_AUTHORS = "unknown"
DEFAULT_TITLE = "unknown"
DEFAULT_REFERENCE = ""
DEFAULT_OFFSET = -1
DEFAULT_LENGTH = 0
DEFAULT_TYPE = "unknown"
DEFAULT_OBFUSCATION = "none"

_FEATURE_SCHEMA = ("_name string, _authors string, _title string, _lang string, "
                   "_source_reference string, _this_offset string, _this_length string, "
                   "_type string, _obfuscation string, _corrupt_record string")

_PROLOG = r"<\?[\s\S]*?\?>|<!--[\s\S]*?-->|<!DOCTYPE[^>]*>"
_ONE_ELEMENT = r"^<([A-Za-z_][\w.:-]*)[\s\S]*</\1\s*>$"
_ONE_EMPTY_ELEMENT = r"^<[A-Za-z_][^<>]*/>$"


def _file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def _parent(path):
    return F.regexp_replace(path, "/[^/]*$", "")


def decode_text(content) -> F.Column:
    """UTF-8 with undecodable bytes dropped and universal newlines.

    ``make_valid_utf8`` turns each invalid sequence into U+FFFD, which is then
    deleted (so a genuine U+FFFD in the file is deleted too)."""
    text = F.make_valid_utf8(content.cast("string"))
    text = F.replace(text, F.lit("�"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def list_text_files(spark: SparkSession, root: str, side: str) -> DataFrame:
    """``(path, part, id, type)`` for every ``part*/*.txt`` of a side
    (content is not read: the binaryFile source only reads bytes when the
    ``content`` column is used)."""
    pattern = f"{root.rstrip('/')}/{BASE}/{SIDES[side]}/part*/*.txt"
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.select(
        "path",
        F.element_at(F.split(_parent("path"), "/"), -1).alias("part"),
        F.replace(_file_name("path"), F.lit(".txt"), F.lit("")).alias("id"),
        F.lit(side).alias("type"))


def sample_cap(listing: DataFrame, n: int | None, *, part: str = "part", key: str = "id",
               seed: int = 42) -> DataFrame:
    """At most ``n`` rows, filled part by part (parts in name order) and
    in a seeded hash order inside a part - deterministic, unlike a random
    pick, so recomputation after a lost executor selects the same rows. The
    hash is ``md5('<seed>|<key>')``, which plain SQL engines compute alike.

    Nothing is sorted as a whole: running totals of the parts' counts name the part that overflows, running totals of its
    counts by the first digits of the hash the digits that do, and only rows with those are ranked."""
    if n is None:
        return listing
    hashed = F.coalesce(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.lit(""))
    rows = listing.withColumn("_h", hashed).withColumn("_d", F.left("_h", F.lit(3)))
    whole, left = F.lit(False), int(n)

    def overflow(df: DataFrame, by: str) -> tuple[Column, Column | None, int]:
        """What fits whole, the value that overflows, and the room left for it."""
        room, fits = left, F.lit(False)
        counts = df.groupBy(by).count().collect()  # a row per part, or per three digits
        for value, count in sorted(((r[by], r["count"]) for r in counts), key=lambda x: (x[0] is not None, x[0])):
            if count > room:
                return fits, F.col(by).eqNullSafe(F.lit(value)), room
            fits, room = (F.col(by).isNull() if value is None else F.col(by).isNull() | (F.col(by) <= value)), room - count
        return fits, None, room

    fits, over, left = overflow(rows, part)
    whole = whole | fits
    if over is None:
        return rows.where(whole).drop("_h", "_d")
    fits, digits, left = overflow(rows.where(over), "_d")
    order = Window.partitionBy(part).orderBy("_h", F.col(key))
    ranked = rows.where(over & digits).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= left).drop("_r")
    return rows.where(whole | (over & fits)).unionByName(ranked).drop("_h", "_d")


def read_sidecars(spark: SparkSession, root: str, side: str) -> DataFrame:
    """One metadata struct per sidecar file, keyed by its path.

    ``about`` features give authors/title/language (the last one wins),
    ``plagiarism`` features give the annotation list in document order with
    the format's defaults. A file that does not parse, or whose offset/length
    is not an integer, keeps only ``language = 'unknown'``."""
    pattern = f"{root.rstrip('/')}/{BASE}/{SIDES[side]}/part*/*.xml"
    reader = (spark.read.format("xml").option("rowTag", "feature").option("mode", "PERMISSIVE")
              .schema(_FEATURE_SCHEMA))
    try:
        raw = reader.load(pattern)
        whole_text = spark.read.text(pattern, wholetext=True)
    except Exception as exc:  # no sidecar at all matches the glob
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("xml_path", T.StringType()),
                                                       T.StructField("metadata", METADATA_TYPE)]))
    rows = (raw
            .select("*", F.col("_metadata.file_path").alias("xml_path"),
                    F.monotonically_increasing_id().alias("pos")))
    bad_int = lambda c: F.col(c).isNotNull() & F.col(c).try_cast("int").isNull()
    is_plag = F.col("_name") == "plagiarism"
    is_about = F.col("_name") == "about"
    ann = F.struct(
        F.coalesce("_source_reference", F.lit(DEFAULT_REFERENCE)).alias("source_reference"),
        F.coalesce(F.col("_this_offset").try_cast("int"), F.lit(DEFAULT_OFFSET)).alias("offset"),
        F.coalesce(F.col("_this_length").try_cast("int"), F.lit(DEFAULT_LENGTH)).alias("length"),
        F.coalesce("_type", F.lit(DEFAULT_TYPE)).alias("type"),
        F.coalesce("_obfuscation", F.lit(DEFAULT_OBFUSCATION)).alias("obfuscation"))
    about = F.struct(F.coalesce("_authors", F.lit(DEFAULT_AUTHORS)).alias("authors"),
                     F.coalesce("_title", F.lit(DEFAULT_TITLE)).alias("title"),
                     F.coalesce("_lang", F.lit(DEFAULT_LANGUAGE)).alias("language"))
    per_file = rows.groupBy("xml_path").agg(
        F.max(F.col("_corrupt_record").isNotNull()
              | (is_plag & (bad_int("_this_offset") | bad_int("_this_length")))).alias("bad"),
        F.max_by(F.when(is_about, about), F.when(is_about, F.col("pos"))).alias("about"),
        F.sort_array(F.collect_list(F.when(is_plag, F.struct(F.col("pos"), ann.alias("a"))))).alias("plag"))
    # A file the reader could not find features in may still be malformed as
    # a whole (truncated, mismatched tags): parse each file once more as one
    # XML value and gate on its corrupt-record marker.
    # A single root element must remain once the prolog, comments and
    # processing instructions are removed (several roots do not parse).
    body = F.regexp_replace(F.regexp_replace("value", _PROLOG, ""), r"^\s+|\s+$", "")
    single_root = body.rlike(_ONE_ELEMENT) | body.rlike(_ONE_EMPTY_ELEMENT)
    whole = (whole_text
             .select(F.col("_metadata.file_path").alias("xml_path"),
                     (F.from_xml("value", "struct<_corrupt_record string>", {"mode": "PERMISSIVE"})
                      ["_corrupt_record"].isNotNull() | ~single_root).alias("malformed")))
    per_file = (per_file.join(whole, "xml_path", "full_outer")
                .withColumn("bad", F.coalesce("bad", F.lit(False)) | F.coalesce("malformed", F.lit(False)))
                .filter(F.col("bad") | F.col("plag").isNotNull()))
    plagiarism = F.when(F.size("plag") > 0, F.transform("plag", lambda x: x["a"]))
    good = F.struct(F.col("about.authors").alias("authors"), F.col("about.title").alias("title"),
                    F.col("about.language").alias("language"),
                    plagiarism.cast(F.ArrayType(ANNOTATION_TYPE)).alias("plagiarism"))
    unknown = F.struct(F.lit(None).cast("string").alias("authors"),
                       F.lit(None).cast("string").alias("title"),
                       F.lit(DEFAULT_LANGUAGE).alias("language"),
                       F.lit(None).cast(F.ArrayType(ANNOTATION_TYPE)).alias("plagiarism"))
    return per_file.select("xml_path",
                           F.when(F.col("bad"), unknown).otherwise(good).cast(METADATA_TYPE).alias("metadata"))


def load_corpus(spark: SparkSession, root: str, *, max_src: int | None = None,
                max_sus: int | None = None, seed: int = 42, prepare: bool = True,
                prep: dict | None = None, reader: str = "source") -> DataFrame:
    """The labelled corpus as one documents frame
    ``id, type, raw_text, [processed_text, tokens,] metadata, has_plagiarism``.

    Every document is loaded unless a caller asks for a sample of a side
    (``max_src``, ``max_sus``), which is drawn from the file listing and joined to the
    contents. ``has_plagiarism`` is set on suspicious rows only.

    ``reader='source'`` is the data source of ``sources.labelled``, a partition per part folder; ``'jvm'`` reads through
    Spark's file and XML sources, for file systems that only Hadoop's clients open.
    """
    if reader == "source":
        from palimpsest.sources.labelled import read_labelled, sample_bounds

        bounds = sample_bounds(spark, root, {"source": max_src, "suspicious": max_sus}, seed)
        docs = read_labelled(spark, root, bounds=json.dumps(bounds), seed=str(seed))
        docs = docs.select("id", "type", "raw_text", "metadata",
                           F.when(F.col("type") == "suspicious", F.col("metadata.plagiarism").isNotNull())
                           .alias("has_plagiarism"))
        return prepare_documents(docs, **(prep or {})) if prepare else docs
    if reader != "jvm":
        raise ValueError(f"unknown reader {reader!r}")
    sides = []
    for side, cap in (("source", max_src), ("suspicious", max_sus)):
        listing = sample_cap(list_text_files(spark, root, side), cap, seed=seed)
        content = spark.read.format("binaryFile").load(
            f"{root.rstrip('/')}/{BASE}/{SIDES[side]}/part*/*.txt").select("path", "content")
        listing, _ = broadcast_if_bounded(listing)
        docs = content.join(listing, "path").withColumn("raw_text", decode_text(F.col("content"))).drop("content")
        docs = docs.withColumn("xml_path", F.concat(_parent("path"), F.lit("/"), F.col("id"),
                                                    F.lit(".xml")))
        meta = read_sidecars(spark, root, side)
        docs = docs.join(meta, "xml_path", "left").select(
            "id", "type", "raw_text", "metadata",
            (F.col("metadata.plagiarism").isNotNull() if side == "suspicious"
             else F.lit(None).cast("boolean")).alias("has_plagiarism"))
        sides.append(docs)
    if not sides:
        raise ValueError(f"no documents under {root}")
    out = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return prepare_documents(out, **(prep or {})) if prepare else out
