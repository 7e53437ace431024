"""Sentences split with abbreviations learned from the corpus.

The unsupervised method of Kiss and Strunk ("Unsupervised multilingual sentence boundary detection", 2006), as one
aggregation over the distinct words of the corpus. A word is an abbreviation if it has a full stop far more often
than words in general do: the log-likelihood ratio of "a full stop with probability 0.99" against "as often as after any
word", scaled down for long words and for each occurrence without a full stop and up for full stops inside.
The same aggregation counts, for the orthographic rule, how often a word begins in lower case, and in upper case within a sentence.

A sentence ends at a token with ``!`` or ``?`` at its end, or a full stop, closing marks aside. A full stop of an abbreviation
only counts if the next word begins in upper case, is known in lower case, and never stands in upper case within a
sentence. White space inside a sentence becomes one space.

The words that matter to a document are joined to it (a few per document), so the list of abbreviations is
never held whole by a task or the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import WS_RUN
from palimpsest.operators.sizing import broadcast_if_bounded, reused

# The marks that may stand before and behind a word, and the published parameters.
OPENING = "[(\\[{\"'«“‘„]"
CLOSING = "[)\\]}\"'»”’,;:]"
P_ABBREVIATION = 0.99
THRESHOLD = 0.3
#: Last characters that a token can have if a sentence or clause ends with it.
ENDS = ".!?:;…)]}\"'»”’,"
#: Sentence mark between tokens: white space, so no token holds it.
MARK = "\x1e"


def text_tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS_RUN), lambda t: t != "")


def core(token: Column) -> Column:
    """The token without opening and closing marks around it."""
    return F.regexp_replace(token, f"^{OPENING}+|{CLOSING}+\\z", "")


def _word(token: Column) -> Column:
    """The core in lower case, without a full stop at its end."""
    return F.regexp_replace(F.lower(core(token)), "\\.\\z", "")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n, n_stop, n_lower, n_upper_inside`` of every word with a letter, over all of ``docs``.

    Tokens are counted as they stand, inside a sentence and not; patterns see each distinct one once."""
    tokens = docs.select(text_tokens(F.col(text)).alias("t"))
    before = F.concat(F.array(F.lit("")), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))))
    pairs = tokens.select(F.explode_outer(F.arrays_zip(F.col("t").alias("t"), before.alias("b"))).alias("x")).where(F.col("x.t").isNotNull())
    b = F.col("x.b")
    inside = (b != "") & ~(F.contains(F.lit(ENDS), F.right(b, F.lit(1))) & b.rlike(f"[.!?:;…]{CLOSING}*\\z"))
    seen = pairs.select(F.col("x.t").alias("t"), inside.alias("inside")).groupBy("t", "inside").agg(F.count(F.lit(1)).alias("n"))
    rows = seen.select(_word(F.col("t")).alias("word"), core(F.col("t")).alias("c"), "inside", "n")
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    return rows.where(F.col("word").rlike("\\p{L}")).groupBy("word").agg(
        F.sum("n").alias("n"), total(F.endswith("c", F.lit("."))).alias("n_stop"),
        total(F.col("c").rlike("^\\p{Ll}")).alias("n_lower"), total(F.col("c").rlike("^\\p{Lu}") & F.col("inside")).alias("n_upper_inside"))


def scored_words(counts: DataFrame) -> DataFrame:
    """``counts`` with ``score``, ``is_abbreviation`` and ``is_starter``."""
    counts = reused(counts)
    total = counts.agg(F.sum("n").alias("all_words"), F.sum("n_stop").alias("all_stops"))
    n, stop = F.col("n").cast("double"), F.col("n_stop").cast("double")
    p = F.greatest(F.least(F.col("all_stops") / F.col("all_words"), F.lit(1 - 1e-9)), F.lit(1e-9))
    ratio = 2 * (stop * F.log(F.lit(P_ABBREVIATION)) + (n - stop) * F.log(F.lit(1 - P_ABBREVIATION))
                 - stop * F.log(p) - (n - stop) * F.log(1 - p))
    letters = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    score = ratio * F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters, stop - n)
    # one row of totals beside the counts
    out = counts.join(F.broadcast(total.withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).withColumn("score", score)
    return out.select("word", "n", "n_stop", "n_lower", "n_upper_inside", "score",
                      ((F.col("n_stop") > 0) & (F.col("score") >= THRESHOLD)).alias("is_abbreviation"),
                      ((F.col("n_lower") > 0) & (F.col("n_upper_inside") == 0)).alias("is_starter"))


def learned_sentences(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", out: str = "sentences") -> DataFrame:
    """``docs`` with the array ``out`` of each text's sentences; ``words`` as from ``scored_words``. ``key`` names the rows."""
    tokens = text_tokens(F.col(text))
    follow = F.concat(F.slice(F.col("t"), 2, F.size("t")), F.array(F.lit("")))
    # most tokens have no such mark and need no pattern
    stops = lambda t: F.contains(t, F.lit(".")) & F.endswith(core(t), F.lit("."))
    calls = lambda t: (F.contains(t, F.lit("!")) | F.contains(t, F.lit("?"))) & core(t).rlike("[!?]\\z")
    capital = lambda t: core(t).rlike("^\\p{Lu}")
    # words of tokens with a full stop, and capitalised words behind them
    both = F.filter(F.arrays_zip(F.col("t").alias("t"), follow.alias("f")), lambda x: stops(x["t"]))
    beside = docs.select(key, tokens.alias("t")).select(key, F.explode_outer(both).alias("x")).where(
        F.col("x.t").isNotNull()).select(key, F.col("x.t").alias("t"), F.col("x.f").alias("f"))
    asked = beside.select(key, _word(F.col("t")).alias("word"), F.lit("abbreviation").alias("kind")).unionByName(
        beside.where(capital(F.col("f"))).select(key, _word(F.col("f")).alias("word"), F.lit("starter").alias("kind"))).distinct()
    known = words.where("is_abbreviation").select("word", F.lit("abbreviation").alias("kind")).unionByName(
        words.where("is_starter").select("word", F.lit("starter").alias("kind")))
    known, _ = broadcast_if_bounded(known)
    found = asked.join(known, ["word", "kind"]).groupBy(key).agg(
        F.collect_set(F.when(F.col("kind") == "abbreviation", F.col("word"))).alias("_abbreviations"),
        F.collect_set(F.when(F.col("kind") == "starter", F.col("word"))).alias("_starters"))
    none = F.array().cast("array<string>")
    # texts alone go through the join; their tokens are cut behind it
    base = docs.join(found, key, "left").withColumn("t", tokens).withColumn("_a", F.coalesce("_abbreviations", none)).withColumn("_s", F.coalesce("_starters", none))

    def marked(t: Column, f: Column) -> Column:
        starts = capital(f) & F.array_contains(F.col("_s"), _word(f))
        ends = calls(t) | (stops(t) & (~F.array_contains(F.col("_a"), _word(t)) | starts))
        return F.when(ends, F.concat(t, F.lit(MARK))).otherwise(t)

    joined = F.array_join(F.zip_with("t", follow, marked), " ")
    sentences = F.filter(F.split(joined, f"{MARK} ?"), lambda s: s != "")
    return base.withColumn(out, sentences).drop("t", "_abbreviations", "_starters", "_a", "_s")
