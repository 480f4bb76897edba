"""Repeat along NEXT from every conversation, against brute force."""

import pytest

from tessera import queries


@pytest.mark.parametrize("name, depth", [("repeat_next", 3), ("repeat_deep", 8)])
def test_all_conversations(spark, name, depth):
    folder = "/root/testdata/sf0.01"
    turns = {(r["conv_id"], r["turn"]) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn").collect()}
    want = {(c, t) for c, t in turns if t <= depth and all((c, k) in turns for k in range(t))}
    assert max(c for c, _ in want) >= 50
    found = [tuple(r) for r in queries.queries()[name](spark, folder).select("conv_id", "turn").collect()]
    assert sorted(found) == sorted(want)
