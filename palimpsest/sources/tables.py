"""Parquet table scans (S9) and the adapter from the given tables to the
reference's document model.

The given tables have no source/suspicious split and no truth sidecars, so
the adapter takes ``benchmark`` passages as the *source* corpus and every
row of ``documents`` as a *suspicious* document, and derives the truth
annotations from exact containment of a passage in a document (a document
that holds a benchmark passage verbatim reused it).
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import WS_RUN
from palimpsest.operators.sizing import bounded, broadcast_if_bounded, ensure_parallel, reused, row_bytes
from palimpsest.schemas import ANNOTATION_TYPE, METADATA_TYPE
from palimpsest.session import ship_package

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Identifiers in the labelled corpus's file naming style, so
# that the substring truth test behaves as on that corpus.
SOURCE_ID_FORMAT = "source-document%05d"
SUSPICIOUS_ID_FORMAT = "suspicious-document%05d"
REFERENCE_FORMAT = "source-document%05d.txt"

# Characters of the key that finds a short passage inside tokens.
_GRAM = 3

# Two-word passages up to so many are looked up where the texts are (see ``_beside``), with the endings of so many distinct tokens kept.
_MAX_LOOKED_UP = 50_000
_MAX_KEPT = 50_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _words_in_tokens(vocabulary: DataFrame, words: DataFrame, side: str, at_end: bool, few) -> DataFrame:
    """``side, token, word``: the distinct tokens that end (``at_end``) or begin with each distinct
    ``word``, by an equi-join of their endings or beginnings of the lengths that occur."""
    words = words.distinct()
    lengths = [r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect()]  # one number per word length
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("token"))
    ends = vocabulary.select("token", F.explode_outer(cuts).alias("n")).where(F.col("n").isNotNull())
    word = F.right("token", F.col("n")) if at_end else F.left("token", F.col("n"))
    return ends.select(F.lit(side).alias("side"), "token", word.alias("word")).join(few(words), "word").select("side", "token", "word")


class _Kept(dict):
    """What ``find`` gives for a key, kept for a bounded number of keys."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, key):
        if len(self) >= _MAX_KEPT:
            self.clear()
        self[key] = found = self.find(key)
        return found


def _tree(words: dict, reverse: bool = False) -> dict:
    """``words`` as nested dicts by character (from the end if ``reverse``), a word's value under ``""``."""
    root: dict = {}
    for word, value in words.items():
        node = root
        for char in reversed(word) if reverse else word:
            node = node.setdefault(char, {})
        node[""] = value
    return root


def _along(node: dict, chars) -> list:
    """The values of the words of a ``_tree`` that ``chars`` begin with."""
    found = []
    for char in chars:
        node = node.get(char)
        if node is None:
            break
        if "" in node:
            found.append(node[""])
    return found


def _beside(passages):
    """``_dk, _pk`` of ``_dk, _dt`` rows and the two-word passages each text holds. ``passages`` is a broadcast table
    ``_pk, first, gap, second``; every two adjacent tokens with a passage's gap between them are looked up by the
    endings of the left one that are first words, and among the second words after these by the beginnings of the right one."""

    def run(batches):
        table, runs = passages.value, re.compile(r"(\s+)")  # the characters of WS_RUN
        after: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))  # gap, first word, second word -> rows
        for row, (gap, first, second) in enumerate(zip(*(table[c].to_pylist() for c in ("gap", "first", "second")))):
            after[gap][first][second].append(row)

        def endings(firsts):
            tree = _tree({first: _tree(rest) for first, rest in firsts.items()}, reverse=True)
            return _Kept(lambda token: _along(tree, reversed(token)))

        left_of = {gap: endings(firsts) for gap, firsts in after.items()}
        keys = table["_pk"].combine_chunks()
        for batch in batches:
            texts, at, held_rows = batch.column("_dt"), [], []
            for i in range(batch.num_rows):
                parts, held = runs.split(texts[i].as_py() or ""), set()
                for left, gap, right in zip(parts[::2], parts[1::2], parts[2::2]):
                    if gap in left_of:
                        for rest in left_of[gap][left]:
                            if right[:1] in rest:
                                for rows in _along(rest, right):
                                    held.update(rows)
                at += [i] * len(held)
                held_rows += held
            yield pa.RecordBatch.from_arrays([batch.column("_dk").take(pa.array(at, pa.int64())),
                                              keys.take(pa.array(held_rows, pa.int64()))], names=["_dk", "_pk"])

    return run


def _contained(docs: DataFrame, passages: DataFrame, doc_key: str, doc_text: str, passage_key: str,
               passage_text: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """``(sure, open, texts)``: pairs ``(_dk, _pk)`` that hold, pairs still to verify (None if no passage needs it), and the
    passages ``(_pk, _pt)`` (see ``passage_documents``)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(passage_text), F.lit(""))
    parts = F.split(text, WS_RUN)
    pieces = F.filter(parts, lambda x: x != "")
    longest = F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))["x"]
    kind = F.when(F.size(parts) >= 3, "inner").when(F.size(pieces) == 2, "pair").when(F.size(parts) == 1, "word").otherwise("edge")
    p = reused(passages.select(
        F.col(passage_key).alias("_pk"), F.col(passage_text).alias("_pt"), kind.alias("kind"), F.size(parts).alias("n_parts"),
        F.when(F.size(parts) >= 3, F.array_distinct(F.slice(parts, 2, F.size(parts) - 2))).alias("inner"),
        F.get(parts, 0).alias("first"), F.regexp_extract(text, f"({WS_RUN})", 1).alias("gap"), F.get(parts, 1).alias("second"),
        longest.alias("long")).where(F.col("long").isNotNull()))
    sizes = {r["kind"]: r for r in p.groupBy("kind").agg(F.sum("n_parts").alias("n"), F.sum(row_bytes(p)).alias("size")).collect()}  # four at most
    # what is taken from the passages has no more rows than they have words, and no more bytes
    small = bounded(spark, sum(r["n"] for r in sizes.values()), sum(r["size"] for r in sizes.values()))
    few = F.broadcast if small else (lambda df: df)
    d = ensure_parallel(docs.select(F.col(doc_key).alias("_dk"), F.col(doc_text).alias("_dt")), "_dk")
    whole = F.coalesce(F.col("_dt"), F.lit(""))
    split = F.split(whole, WS_RUN)
    keyed = (d.select("_dk", F.explode_outer(F.array_distinct(split)).alias("token"))
             .filter(F.col("token").isNotNull()))
    none = spark.createDataFrame([], T.StructType([d.schema["_dk"], p.schema["_pk"]]))
    sure, open_ = [none], []
    looked_up = small and "pair" in sizes and sizes["pair"]["n"] <= 2 * _MAX_LOOKED_UP  # a pair has two parts
    if sizes.keys() - ({"inner", "pair"} if looked_up else {"inner"}):
        vocabulary = reused(keyed.select("token").distinct())

    if "inner" in sizes:
        inner = p.where("kind = 'inner'").select("_pk", F.size("inner").alias("n"), F.explode("inner").alias("token"))
        freq = keyed.join(few(inner.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        anchors = (inner.join(freq, "token").groupBy("_pk", "n").agg(
            F.count(F.lit(1)).alias("found"), F.min(F.struct("df", "token")).alias("rarest"))
            .where("found = n").select("_pk", F.col("rarest.token").alias("token")))
        open_.append(keyed.join(few(reused(anchors)), "token").select("_dk", "_pk"))

    if looked_up:
        ship_package(spark)
        table = spark.sparkContext.broadcast(p.where("kind = 'pair'").select("_pk", "first", "gap", "second").toArrow())  # bounded, as measured
        sure.append(d.mapInArrow(_beside(table), none.schema))
    elif "pair" in sizes:
        pairs = p.where("kind = 'pair'").select("_pk", "first", "gap", "second")
        sides, light = broadcast_if_bounded(
            _words_in_tokens(vocabulary, pairs.select(F.col("first").alias("word")), "left", True, few).unionByName(
                _words_in_tokens(vocabulary, pairs.select(F.col("second").alias("word")), "right", False, few)))
        hint = F.broadcast if light else (lambda df: df)
        left = hint(sides.where("side = 'left'").select(F.col("token").alias("left"), F.col("word").alias("first")))
        right = hint(sides.where("side = 'right'").select(F.col("token").alias("right"), F.col("word").alias("second")))
        arrays = d.select("_dk", split.alias("t"), F.regexp_extract_all(whole, F.lit(f"({WS_RUN})"), 1).alias("gaps"))
        beside = arrays.select("_dk", F.explode_outer(F.arrays_zip(
            F.col("t").alias("left"), F.col("gaps").alias("gap"), F.slice("t", 2, F.size("t")).alias("right"))).alias("x"))
        beside = beside.select("_dk", "x.left", "x.gap", "x.right").where(F.col("right").isNotNull())
        sure.append(beside.join(left, "left").join(right, "right").join(few(pairs), ["first", "gap", "second"]).select("_dk", "_pk"))

    if sizes.keys() & {"word", "edge"}:
        short = p.where("kind IN ('word', 'edge')").select("_pk", "kind", "long", F.substring("long", 1, _GRAM).alias("gram"))
        size = F.explode(F.sequence(F.lit(1), F.lit(_GRAM))).alias("g")
        grams = vocabulary.select("token", size).where(F.length("token") >= F.col("g")).select("token", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length("token") - F.col("g") + 1), lambda i: F.substring("token", i, F.col("g"))))).alias("gram"))
        holds, _ = broadcast_if_bounded(grams.join(few(short), "gram").where(F.contains("token", "long"))
                                        .select("token", "_pk", "kind").distinct())
        found = keyed.join(holds, "token")
        sure.append(found.where("kind = 'word'").select("_dk", "_pk"))
        open_.append(found.where("kind = 'edge'").select("_dk", "_pk"))
    return reduce(DataFrame.unionByName, sure), reduce(DataFrame.unionByName, open_) if open_ else None, few(p.select("_pk", "_pt"))


def _verified(docs: DataFrame, pairs: DataFrame, texts: DataFrame, doc_key: str, doc_text: str) -> DataFrame:
    """The pairs that hold, with both texts (a repeated key names several texts)."""
    pairs, _ = broadcast_if_bounded(pairs.distinct())
    return docs.select(F.col(doc_key).alias("_dk"), F.col(doc_text).alias("_dt")).join(pairs, "_dk").join(
        texts, "_pk").where(F.contains("_dt", "_pt"))


def passage_documents(docs: DataFrame, passages: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text",
                      passage_key: str = "item_id", passage_text: str = "text") -> DataFrame:
    """Every distinct ``(doc_key, passage_key)`` where the document contains the passage verbatim.

    Exact without a nested loop, by the shape of the passage when split at whitespace runs:

    * A piece that is neither the first nor the last is bounded by whitespace inside the passage, so every
      document containing the passage has it as a whole token. All those pieces must occur, and the one in the
      fewest documents is the passage's anchor, equi-joined with the documents' distinct tokens; the
      candidates are verified with ``contains``.
    * Two words: the document has two adjacent tokens, with the same whitespace between them, of which the
      first ends with the first word and the second begins with the second. A measured, bounded number of such passages is broadcast and
      adjacent tokens are looked up in it where the texts are; only pairs that hold move. With more passages, which
      distinct tokens end or begin with which words is worked out once over the vocabulary; adjacent tokens then lead to
      pairs of words and these, by equality, to passages. Nothing is left to verify either way.
    * One word: it lies inside a token, and is looked up in the distinct tokens by its first characters
      (an equi-join with the tokens' character n-grams). With whitespace at an edge, the
      documents of those tokens are candidates to verify.

    A blank passage is in no document.
    """
    sure, open_, texts = _contained(docs, passages, doc_key, doc_text, passage_key, passage_text)
    if open_ is not None:
        sure = sure.unionByName(_verified(docs, open_, texts, doc_key, doc_text).select("_dk", "_pk"))
    return sure.distinct().select(F.col("_dk").alias(doc_key), F.col("_pk").alias(passage_key))


def passage_containment(docs: DataFrame, passages: DataFrame, *, doc_key: str = "doc_id",
                        doc_text: str = "text", passage_key: str = "item_id",
                        passage_text: str = "text") -> DataFrame:
    """``passage_documents`` with places: ``(doc_key, passage_key, offset, length)``, ``offset``
    the 0-based character position of the first occurrence."""
    sure, open_, texts = _contained(docs, passages, doc_key, doc_text, passage_key, passage_text)
    return _verified(docs, sure if open_ is None else sure.unionByName(open_), texts, doc_key, doc_text).select(
        F.col("_dk").alias(doc_key), F.col("_pk").alias(passage_key),
        (F.expr("instr(_dt, _pt)") - 1).cast("int").alias("offset"), F.length("_pt").cast("int").alias("length"))


def truth_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived truth cases by themselves, as ``truth_cases`` gives them: the passages of
    ``benchmark`` that each document holds, in document order. Detection joins
    them to its matches; the documents' texts never carry them."""
    hits = passage_containment(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    order = Window.partitionBy("doc_id").orderBy("offset", "item_id")
    return hits.select(
        F.format_string(SUSPICIOUS_ID_FORMAT, "doc_id").alias("suspicious_id"),
        (F.row_number().over(order) - 1).alias("ordinal"),
        F.format_string(REFERENCE_FORMAT, "item_id").alias("source_reference"), "offset", "length",
        F.lit("unknown").alias("type"), F.lit("none").alias("obfuscation"))


def phrase_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``phrase, n_docs``: every distinct two-word phrase of the ``benchmark`` texts, and how
    many ``documents`` contain it."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), WS_RUN), lambda x: x != "")
    pairs = read_table(spark, sf_dir, "benchmark").select(words.alias("w")).where(F.size("w") > 1).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(
            " ", F.get("w", i - 1), F.get("w", i)))).alias("phrase")).distinct()
    phrases = reused(pairs.select(F.monotonically_increasing_id().alias("item_id"), F.col("phrase").alias("text")))
    hits = passage_documents(read_table(spark, sf_dir, "documents"), phrases)
    counts = hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return phrases.join(counts, "item_id", "left").select(
        F.col("text").alias("phrase"), F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))


def truth_metadata(containment: DataFrame, doc_key: str = "doc_id",
                   passage_key: str = "item_id") -> DataFrame:
    """Group containment rows into one ``metadata`` struct per document, with
    the ``plagiarism`` annotations in document order (by offset)."""
    ann = F.struct(F.format_string(REFERENCE_FORMAT, F.col(passage_key)).alias("source_reference"),
                   F.col("offset"), F.col("length"),
                   F.lit("unknown").alias("type"), F.lit("none").alias("obfuscation"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("offset").alias("_o"),
                                                   F.col(passage_key).alias("_p"),
                                                   ann.alias("a"))))
    return (containment.groupBy(doc_key)
            .agg(F.transform(ordered, lambda x: x["a"]).cast(F.ArrayType(ANNOTATION_TYPE))
                 .alias("plagiarism")))


def corpus_from_tables(spark: SparkSession, sf_dir: str, with_truth: bool = True) -> DataFrame:
    """Reference-shaped documents: ``benchmark`` rows as sources, ``documents``
    rows as suspicious documents with derived truth in ``metadata``.

    Columns: ``id, type, raw_text, metadata, has_plagiarism`` (has_plagiarism
    is NULL on source rows, as the key is absent there in the reference).
    """
    docs = read_table(spark, sf_dir, "documents")
    bench = read_table(spark, sf_dir, "benchmark")
    empty_meta = F.lit(None).cast(METADATA_TYPE)
    sources = bench.select(F.format_string(SOURCE_ID_FORMAT, "item_id").alias("id"),
                           F.lit("source").alias("type"), F.col("text").alias("raw_text"),
                           empty_meta.alias("metadata"),
                           F.lit(None).cast("boolean").alias("has_plagiarism"))
    if with_truth:
        truth, _ = broadcast_if_bounded(truth_metadata(passage_containment(docs, bench)))  # <= candidates
        sus = docs.join(truth, "doc_id", "left")
        meta = F.when(F.col("plagiarism").isNotNull(),
                      F.struct(F.lit(None).cast("string").alias("authors"),
                               F.lit(None).cast("string").alias("title"),
                               F.lit(None).cast("string").alias("language"),
                               F.col("plagiarism"))).cast(METADATA_TYPE)
    else:
        sus, meta = docs, empty_meta
    suspicious = sus.select(F.format_string(SUSPICIOUS_ID_FORMAT, "doc_id").alias("id"),
                            F.lit("suspicious").alias("type"), F.col("text").alias("raw_text"),
                            meta.alias("metadata"),
                            meta.getField("plagiarism").isNotNull().alias("has_plagiarism"))
    return sources.unionByName(suspicious)
