"""Split joins against plain ones, with hot keys, null keys and keys of one side only."""

from __future__ import annotations

import random

import pytest

from quernstone.llm import skew


@pytest.mark.parametrize("share", [1, 3, 4096])
@pytest.mark.parametrize("keep", ["", "null", "missing"])
def test_split_join(spark, share, keep, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    rng = random.Random(share)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 4, None]), i) for i in range(200)] + [(9, 900)]
    counts = {k: sum(r[0] == k for r in rows) for k in (1, 2, 3)} | {7: 0}
    few = spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items()], "k int, n long, v string")
    df = spark.createDataFrame(rows, "k int, i int")
    out = skew.split_join(df, few, ["k"], "n", ["i"], keep_null=keep == "null", keep_missing=keep == "missing")
    assert out.columns == ["k", "i", "n", "v"]
    there = {k: (n, f"v{k}") for k, n in counts.items()}
    kept = [r for r in rows if r[0] in there or r[0] is None and keep or keep == "missing"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((k, i, *there.get(k, (None, None))) for k, i in kept), key=str)
    assert skew.split_join(df.limit(0), few, ["k"], "n", ["i"]).collect() == []
    assert skew.split_join(df, few.limit(0), ["k"], "n", ["i"]).collect() == []
