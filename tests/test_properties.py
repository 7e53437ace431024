"""Property tests: Spark text functions against Python's str/re semantics on
generated Unicode text, and cosine-join invariants."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palimpsest.functions import text as TX
from palimpsest.functions.sentences import explode_chunks, with_chunks

from tests import pyref

ALPHABET = (
    "abcxyzABCXYZ_éÉßİıœæøåçñüöäÄÖÜ"       # Latin incl. special case mappings
    "абвгдЖЗИ" "αβγΔΣς" "中文字" "ابت"          # other scripts
    "0123456789٣٤۵१२" "²³¼Ⅻ"               # decimal / other numbers
    "́̈"                           # combining marks
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0   　"  # whitespace
    ".,;:!?-—'\"()[]{}<>&%$#@*/\\|~`^+="    # punctuation and symbols
)

texts = st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=20, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batch=texts)
def test_tokens_property(spark, batch):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(batch)], "id int, t string")
    rows = df.select("id", TX.remove_stopwords(TX.word_tokens("t", html=False)).alias("a"),
                     TX.remove_stopwords(TX.tokenize(TX.normalize("t", html=False))).alias("b")).collect()
    for r in rows:
        expected = pyref.tokens(batch[r.id])
        assert list(r.a) == expected, repr(batch[r.id])
        assert list(r.b) == expected, repr(batch[r.id])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batch=texts)
def test_sentence_chunks_property(spark, batch):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(batch)], "id int, text string")
    for mode, k in (("tfidf", 2), ("dense", 1)):
        got = {}
        for r in explode_chunks(with_chunks(df, "text", mode, k).drop("text")).collect():
            got.setdefault(r.id, []).append((r.chunk_idx, r.chunk_text))
        for i, s in enumerate(batch):
            assert [c for _, c in sorted(got.get(i, []))] == pyref.chunks(s, k, mode), repr(s)
