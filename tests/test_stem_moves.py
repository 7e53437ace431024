"""What stemming moves."""

import pytest

from palimpsest.operators.stemming import stem_token_arrays


@pytest.mark.parametrize("limit", [None, 2])
def test_tokens_move_as_arrays(spark, limit):
    df = spark.createDataFrame([(i, ["cats", "running", f"walks{'e' * (i % 5)}d"]) for i in range(20)] + [(20, [])], "id long, tokens array<string>")
    got = stem_token_arrays(df, key="id", max_broadcast_rows=limit)
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert not [x for x in moved if "_tok" in x] and len(moved) <= 3, plan
    assert {r.id: r.tokens[:2] for r in got.collect()} == {i: ["cat", "run"] for i in range(20)} | {20: []}
