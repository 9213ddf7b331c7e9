import random
from collections import defaultdict

from cellweave.llm import percentiles as P

SCHEMA = "cb bigint, cnt bigint, sample string, key bigint, value bigint, n bigint"


def nearest_rank(values, p):
    v = sorted(values)
    return v[max(1, -(-p * len(v) // 100)) - 1]


def brute(data, pcts, least=1):
    by = defaultdict(list)
    for k, v in data:
        if k is not None and v is not None:
            by[k].append(v)
    return {(k, p): nearest_rank(v, p) for k, v in by.items() for p in pcts if len(v) >= least}


def run(make, data, pcts, **kw):
    df = make([(k, v, f"s{i % 3}", 1, 2, 3) for i, (k, v) in enumerate(data)], SCHEMA)
    counts = P.combine(P.value_counts(df, "cb", "cnt", ["sample"]))
    return {(r.key, r.pct): r.value for r in P.percentiles(counts, pcts, **kw).collect()}


def test_rounds_of_selection_are_exact(make):
    r = random.Random(4)
    data = [(1, r.randrange(-(10**12), 10**12)) for _ in range(700)] + [(2, r.randrange(12)) for _ in range(300)] + [(3, 5)] * 40 + [(4, None), (None, 3), (5, 1)]
    assert run(make, data, (1, 50, 90, 99, 100)) == brute(data, (1, 50, 90, 99, 100))


def test_small_keys_are_left_out_on_demand(make):
    data = [(1, i) for i in range(10)] + [(2, i) for i in range(9)]
    assert run(make, data, (50,), min_rows=10) == brute(data, (50,), 10) == {(1, 50): 4}


def test_parts_combine(make):
    a = make([(1, i, "a", 0, 0, 0) for i in range(50)], SCHEMA)
    b = make([(1, i, "b", 0, 0, 0) for i in range(25, 90)], SCHEMA)
    both = P.combine(P.value_counts(a, "cb", "cnt"), P.value_counts(b, "cb", "cnt", ["sample"]))
    want = nearest_rank([*range(50), *range(25, 90)], 50)
    assert [tuple(r) for r in P.percentiles(both, (50,)).collect()] == [(1, 50, want)]


def test_nothing(make):
    assert run(make, [], (50,)) == {} and run(make, [(None, 1), (1, None)], (50,)) == {}


def test_every_percentile_is_found_as_a_pivot_and_no_group_is_ordered(make, monkeypatch):
    """What a task puts in order are parts and proposals, never a group, however few or many values it has."""
    ordered = []
    plain = P._weighted_median

    def seen(rows, by, value):
        ordered.append((tuple(by), max((r["count"] for r in rows.groupBy(*by).count().collect()), default=0)))
        return plain(rows, by, value)

    monkeypatch.setattr(P, "_weighted_median", seen)
    data = [(1, i) for i in range(900)] + [(2, i) for i in range(4)] + [(3, 7)]
    assert run(make, data, (50, 99)) == brute(data, (50, 99))
    assert len(ordered) > 2 and {b for b, _ in ordered} == {("key", "seg", "part"), ("key", "seg")}
    assert all(n <= 60 for _, n in ordered)


def test_parts_grow_with_the_root(spark):
    from pyspark.sql import functions as F

    left = spark.createDataFrame([(n,) for n in (1, 2, 32, 10_000, 10**12)], "left bigint")
    assert [r[0] for r in left.select(P.parts_of(F.col("left"))).collect()] == [1, 2, 6, 100, 10**6]


def test_many_groups_are_looked_up_without_a_broadcast(make, monkeypatch):
    from cellweave.plans import salting

    monkeypatch.setattr(salting, "BROADCAST_ROWS", 0)
    data = [(k, k * i % 17) for k in range(12) for i in range(20)]
    assert run(make, data, (50, 99)) == brute(data, (50, 99))
