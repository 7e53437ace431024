import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *[T.StructField(c, T.StringType()) for c in ("k", "t", "o", "n", "h", "row", "fp", "kept", "text_hash", "score")]])


def rows_of(pairs):
    out = []
    for i, item in enumerate(pairs):
        doc_id, text, lang = (*item, "en")[:3] if len(item) < 3 else item
        out.append((doc_id, text, lang, None if i % 7 == 3 else f"s{i % 2}", None if text is None else len(text),
                    *["x"] * 10))
    return out


def awkward_texts():
    rng = random.Random(5)
    words = ["the", "of", "and", "zebra", "Émile", "naïve", "straße", "漢字", "x1", "don't", "WORD", "end.", "😀"]
    prose = lambda n: " ".join(rng.choice(words) + (rng.choice(["", "", ",", "\n"])) for _ in range(n))
    base, shared = prose(120), prose(60)
    near = base.split(" ")
    near[50] = "changed"
    return [
        (1, base), (2, base.upper().replace("É", "é")), (3, base), (3, base), (4, " ".join(near)), (5, None), (6, ""), (7, " \n\t "),
        (8, "a"), (9, "word " * 400), (10, "ab" * 40_000), (None, base), (None, "null key " + prose(30)), (11, prose(40) + shared),
        (12, shared + prose(50)), (13, prose(20) + "\n" + shared + "\n" + shared + prose(9)), (14, prose(4000)), (15, "\x00\x01 ▁ ▁▁  two  spaces "),
        (16, "<|endoftext|> and <s> </s> <unk>"), (17, "é" * 3000), (18, "b"), (18, "c"), (19, "... !!! ???"), (20, prose(3)), (-4, prose(2)),
        (2**62, prose(80)), (21, "A b C"), (22, "a B c")]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows_of(awkward_texts()), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda pairs: spark.createDataFrame(rows_of(pairs), SCHEMA)
