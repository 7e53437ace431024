"""What the shuffled joins move."""

import re

import pytest

from palimpsest.operators.simjoin import cosine_pairs


@pytest.mark.parametrize("strategy", ["shuffle", "prefix"])
def test_pairs_are_taken_apart_in_their_part(spark, strategy):
    """No row per pair and term is dealt out: what moves behind the term join holds posting lists."""
    sus = spark.createDataFrame([(f"u{i}", t, 0.5) for i in range(9) for t in ("hot", f"r{i % 3}")] + [(None, "hot", 1.0)], "sus string, term string, w double")
    src = spark.createDataFrame([(f"s{j}", t, 0.5) for j in range(7) for t in ("hot", f"r{j % 3}")] + [(None, "hot", 1.0)], "src string, term string, w double")
    got = cosine_pairs(sus, src, sus_key="sus", src_key="src", threshold=0.1, strategy=strategy, rows_per_salt=4)
    if strategy == "shuffle":
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Generate explode\(_posts[^\n]*\n[^\n]*RepartitionByExpression \[sus", plan)
    plain = cosine_pairs(sus, src, sus_key="sus", src_key="src", threshold=0.1, strategy="broadcast")
    flat = lambda df: sorted((str(r.sus), str(r.src), round(r.similarity, 9)) for r in df.collect())
    if strategy == "shuffle":
        assert flat(got) == flat(plain) and len(flat(got)) == 80
    else:  # the prefix join matches keys by equality, as before
        assert {x for x in flat(got) if "None" not in x} == {x for x in flat(plain) if "None" not in x}
