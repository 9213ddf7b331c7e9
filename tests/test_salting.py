"""Both ways of a lookup give the same rows, and only a counted small side is broadcast."""

import pytest
from pyspark.sql import functions as F

from cellweave.operators.orphans import Child, Parent, orphan_references
from cellweave.plans import salting


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_both_ways(make, rows, how):
    big = make([(i % 3 if i % 7 else None, i) for i in range(200)], "k bigint, v bigint")
    small = make([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "k bigint, s string")
    near, far = (salting.salted_join(big, small, ["k"], F.col("v"), n, 4, how) for n in (4, salting.BROADCAST_ROWS + 1))
    assert rows(near) == rows(far) and len(rows(near)) > 100
    assert "BroadcastHashJoin" in plan_of(near) and "SortMergeJoin" in plan_of(far) and "BroadcastHashJoin" not in plan_of(far)


def test_orphans_of_many_parents(make, rows, monkeypatch):
    children = make([(i % 40, f"2020-03-{1 + i % 9:02d} 01:02:03") for i in range(400)], "k bigint, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    parents = make([(k, f"2020-03-{1 + k % 9:02d} 01:02:03", None if k % 3 else "2020-03-08 12:00:00") for k in range(30)], "k bigint, a string, b string")
    parents = parents.select("k", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    found = lambda: rows(orphan_references([Child("c", children, "k", "at", "p")], [Parent("p", parents, "k", "a", "b")]))
    near = found()
    monkeypatch.setattr(salting, "BROADCAST_ROWS", 0)
    assert found() == near and len(near) > 50
