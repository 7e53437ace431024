"""Porter stemming as column rules over the distinct vocabulary.

The stemmer is the published algorithm (M.F. Porter, "An algorithm for suffix stripping",
1980), written as Spark columns. A word travels with its *shape*, the string of its letters as
``C`` (consonant) and ``V`` (vowel). What the algorithm asks of a stem is then a question to a prefix of
the shape: the measure is the number of ``VC`` in it, "has a vowel" is "contains V", and cutting a
suffix cuts both strings alike. The steps are projections or, for a word inside an array, names bound one after another.

Documents are stemmed through their vocabulary: the frequent tokens (all, if few enough) are stemmed
once each and broadcast, and documents' tokens looked up in them as Arrow arrays; the others, which occur
seldom, are stemmed where they stand, inside the arrays. No token leaves its document and none is sorted.

Words of one or two letters are left alone.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.sizing import reused
from palimpsest.session import broadcast_byte_limit, broadcast_row_limit

#: Bytes of the tokens and stems that Python workers look others up in.
_HEAD_BYTES = 24 << 20

# The suffix rules of the 1980 algorithm, in its order.
STEP2_RULES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3_RULES = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4_SUFFIXES = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


#: What a word ends with that any rule changes, and the shape of letters that are no ``y``.
_LAST = sorted({x[-1] for x in (*dict(STEP2_RULES), *dict(STEP3_RULES), *STEP4_SUFFIXES)} | set("sdgyel"))
_SHAPES = {c: "V" if c in "aeiou" else "C" for c in "abcdefghijklmnopqrstuvwxzCVP"}


def shape(word: Column) -> Column:
    """Each letter as ``C`` or ``V``; ``y`` is a vowel after a consonant, else a consonant.

    In a run of ``y`` the two kinds alternate, so pairs of them (``P``) all read ``VC`` after a
    consonant and ``CV`` elsewhere; ``\\G`` carries that along the run."""
    s = F.regexp_replace(F.translate(word, "".join(_SHAPES), "".join(_SHAPES.values())), "[^CVy]", "C")
    pairs = F.replace(s, F.lit("yy"), F.lit("P"))
    pairs = F.replace(F.regexp_replace(pairs, r"(?:(?<=C)|(?!^)\G)P", "VC"), F.lit("P"), F.lit("CV"))
    return F.when(F.contains(s, F.lit("y")), F.replace(F.replace(pairs, F.lit("Cy"), F.lit("CV")), F.lit("y"), F.lit("C"))).otherwise(s)


def _cut(text: Column, n) -> Column:
    return F.left(text, F.length(text) - n)


def _measure(s: Column) -> Column:
    """m in [C](VC)^m[V]: how often a vowel is followed by a consonant."""
    return (F.length(s) - F.length(F.replace(s, F.lit("VC"), F.lit("")))) / 2


def _has_vowel(s: Column) -> Column:
    return F.contains(s, F.lit("V"))


def _ends(w: Column, *suffixes: str) -> Column:
    return reduce(Column.__or__, (F.endswith(w, F.lit(x)) for x in suffixes))


def _doubled(w: Column, s: Column) -> Column:
    return F.endswith(s, F.lit("C")) & (F.length(w) >= 2) & (F.right(w, F.lit(1)) == F.substring(w, -2, 1))


def _cvc(w: Column, s: Column) -> Column:
    return F.endswith(s, F.lit("CVC")) & ~_ends(w, *"wxy")


def _chosen(of: dict, by) -> Column:
    """The value in ``of`` of the first key that ``by`` holds for, else an empty string."""
    return reduce(lambda so_far, key: so_far.when(by(key), of[key]), list(of)[1:], F.when(by(list(of)[0]), of[list(of)[0]])).otherwise("")


def _suffix_step(suffixes, allowed, replacement=None) -> list:
    """The longest of ``suffixes`` is replaced where ``allowed`` says so of what stands before it."""
    longest_first = sorted(suffixes, key=len, reverse=True)

    def found(w, s, x, n):
        return {"x": _chosen({f: f for f in longest_first}, lambda f: F.endswith(w, F.lit(f)))}

    def counted(w, s, x, n):
        size = F.length(x)
        return {"n": F.when((size > 0) & allowed(_cut(w, size), _cut(s, size), x), size).otherwise(0)}

    def replaced(w, s, x, n):
        if not replacement:
            return {"w": _cut(w, n), "s": _cut(s, n)}
        tails = {f: t for f, t in replacement.items() if t}
        tail, vowels = (F.when(n > 0, _chosen(of, lambda f: x == f)).otherwise("") for of in (
            tails, {f: "".join(_SHAPES[c] for c in t) for f, t in tails.items()}))  # no rule puts in a y
        return {"w": F.concat(_cut(w, n), tail), "s": F.concat(_cut(s, n), vowels)}

    return [found, counted, replaced]


def _cut_step(count) -> list:
    """As many letters as ``count`` says go off the word and its shape."""
    return [lambda w, s, x, n: {"n": count(w, s)}, lambda w, s, x, n: {"w": _cut(w, n), "s": _cut(s, n)}]


def _mended(w, s, x, n) -> dict:
    """A stem that a past tense or participle ending went from gets its ``e`` or loses a doubled letter."""
    undouble = _doubled(w, s) & ~_ends(w, *"lsz")
    return {"x": F.when(n < 2, "").when(_ends(w, "at", "bl", "iz"), "e").when(undouble, "-").when((_measure(s) == 1) & _cvc(w, s), "e").otherwise("")}


def _final_e(w, s) -> Column:
    before = _cut(s, 1)
    return F.when(_ends(w, "e") & ((_measure(before) > 1) | ((_measure(before) == 1) & ~_cvc(_cut(w, 1), before))), 1).otherwise(0)


#: The algorithm as steps on the word ``w``, its shape ``s`` and two notes of a step for the next, ``x`` (text) and ``n`` (a
#: number); each gives what it changes.
_STEPS = [
    # step 1a
    *_cut_step(lambda w, s: F.when(_ends(w, "sses", "ies"), 2).when(_ends(w, "ss"), 0).when(_ends(w, "s"), 1).otherwise(0)),
    # step 1b
    *_cut_step(lambda w, s: F.when(_ends(w, "eed"), F.when(_measure(_cut(s, 3)) > 0, 1).otherwise(0))
               .when(_ends(w, "ed") & _has_vowel(_cut(s, 2)), 2).when(_ends(w, "ing") & _has_vowel(_cut(s, 3)), 3).otherwise(0)),
    _mended,
    lambda w, s, x, n: {"w": F.when(x == "e", F.concat(w, F.lit("e"))).when(x == "-", _cut(w, 1)).otherwise(w),
                        "s": F.when(x == "e", F.concat(s, F.lit("V"))).when(x == "-", _cut(s, 1)).otherwise(s)},
    # step 1c
    lambda w, s, x, n: {"n": F.when(_ends(w, "y") & _has_vowel(_cut(s, 1)), 1).otherwise(0)},
    lambda w, s, x, n: {"w": F.when(n == 1, F.concat(_cut(w, 1), F.lit("i"))).otherwise(w),
                        "s": F.when(n == 1, F.concat(_cut(s, 1), F.lit("V"))).otherwise(s)},
    # steps 2 to 4
    *_suffix_step(dict(STEP2_RULES), lambda _, before, x: _measure(before) > 0, dict(STEP2_RULES)),
    *_suffix_step(dict(STEP3_RULES), lambda _, before, x: _measure(before) > 0, dict(STEP3_RULES)),
    *_suffix_step(STEP4_SUFFIXES, lambda stem, before, x: (_measure(before) > 1) & ((x != "ion") | _ends(stem, *"st"))),
    # step 5a, 5b
    *_cut_step(_final_e),
    *_cut_step(lambda w, s: F.when((_measure(s) > 1) & _doubled(w, s) & _ends(w, "l"), 1).otherwise(0)),
]


def _may_change(word: Column) -> Column:
    return (F.length(word) > 2) & _ends(word, *_LAST)


def _begun(word: Column) -> dict:
    """What the steps begin with; a word that no rule changes is null there, so that nothing is done for it."""
    w = F.when(_may_change(word), word)
    return {"w": w, "s": shape(w), "x": F.lit(""), "n": F.lit(0)}


def stem_words(words: DataFrame, word: str, out: str = "stem") -> DataFrame:
    """``words`` with the stem of column ``word`` (lower-case tokens; null stays null)."""
    df = words.withColumns({f"_{k}": c for k, c in _begun(F.col(word)).items()})
    for i, step in enumerate(_STEPS):
        df = df.withColumns({f"_{k}": c for k, c in step(*(F.col(f"_{k}") for k in "wsxn")).items()})
        if i % 3 == 1:  # generated as one method, the steps would be too large for the JVM to compile; a lambda parts them
            df = df.withColumn("_w", F.get(F.transform(F.array("_w"), lambda x: x), 0))
    return df.select(*words.columns, F.coalesce("_w", word).alias(out))


def stem_in_place(word: Column) -> Column:
    """The stem of ``word`` as one expression, for tokens inside an array: each step is bound to a name and runs once."""
    def named(values: dict) -> Column:
        return F.struct(*[values[k].alias(k) for k in "wsxn"])

    def taken(step):
        return lambda t: named({k: t[k] for k in "wsxn"} | step(*(t[k] for k in "wsxn")))

    state = F.array(named(_begun(word)))
    for step in _STEPS:
        state = F.transform(state, taken(step))
    return F.when(_may_change(word), F.get(state, 0)["w"]).otherwise(word)


def _looked_up(spark: SparkSession, head: DataFrame):
    """A function of token arrays that gives each token's stem by ``head`` (``_tok, _stem``, bounded by the caller and
    broadcast), null for other tokens. Tokens and stems stay in Arrow arrays, no Python value is made of them."""
    table = spark.sparkContext.broadcast(head.select("_tok", "_stem").toArrow().combine_chunks())

    @F.arrow_udf("array<string>")
    def stems(tokens: pa.Array) -> pa.Array:
        flat = tokens.flatten()
        known, stem = (pa.concat_arrays(table.value[c].chunks or [pa.array([], pa.string())]).cast(flat.type) for c in ("_tok", "_stem"))
        ends = pc.cumulative_sum(pc.cast(pc.list_value_length(tokens), pa.int32()))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), stem.take(pc.index_in(flat, value_set=known)))

    return stems


def stem_token_arrays(df: DataFrame, *, key: str | list[str], tokens_col: str = "tokens",
                      max_broadcast_rows: int | None = None) -> DataFrame:
    """Replace every token array by its stems (see module doc); ``key`` names the rows.

    Rows of the same key get the stems of all of them, by position; a row with a null in its key gets none."""
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    limit = broadcast_row_limit(spark) if max_broadcast_rows is None else max_broadcast_rows
    vocabulary = df.select(F.explode_outer(tokens_col).alias("_tok")).where(F.col("_tok").isNotNull())
    counts = reused(vocabulary.groupBy("_tok").agg(F.count(F.lit(1)).alias("_freq")))
    # the frequent tokens, by powers of two of the frequency, as many as may be broadcast
    sizes = counts.groupBy(F.floor(F.log2("_freq")).cast("int").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(2 * F.octet_length("_tok").cast("long") + 8).alias("bytes")).collect()  # at most 64 rows
    least, held, held_bytes, rest = 1 << 62, 0, 0, 0
    for size, n, size_bytes in sorted(sizes, reverse=True):
        if rest or held + n > limit or held_bytes + size_bytes > min(_HEAD_BYTES, broadcast_byte_limit(spark)):
            rest += n
        else:
            least, held, held_bytes = 1 << size, held + n, held_bytes + size_bytes
    tokens = F.array_compact(F.coalesce(tokens_col, F.array().cast("array<string>")))
    stems = tokens
    if held:
        stems = _looked_up(spark, stem_words(counts.where(F.col("_freq") >= least), "_tok", "_stem"))(tokens)
        if rest:
            stems = F.zip_with(tokens, stems, lambda token, stem: F.coalesce(stem, stem_in_place(token)))
    elif rest:
        stems = F.transform(tokens, stem_in_place)
    named = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    others = [c for c in df.columns if c not in (*keys, tokens_col)]
    out = df.select(*keys, *others, F.when(named, stems).otherwise(F.array().cast("array<string>")).alias(tokens_col))
    repeated = reused(df.where(named).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys))
    if repeated.isEmpty():
        return out
    placed = F.transform(tokens_col, lambda stem, i: F.struct(i.alias("_pos"), stem.alias("_stem")))
    merged = (out.select(*keys, tokens_col).join(repeated, keys, "left_semi").groupBy(*keys)
              .agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("_s"))
              .select(*keys, F.transform("_s", lambda x: x["_stem"]).alias("_merged")))
    return (out.join(merged, keys, "left").select(*keys, *others, F.coalesce("_merged", tokens_col).alias(tokens_col)))
