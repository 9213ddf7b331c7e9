from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cellweave.operators import skew

SCHEMA = "cb bigint, umi bigint, cnt bigint, n bigint, key string, value string"


def profile(rows_in):
    by = defaultdict(list)
    for cb, umi, cnt in rows_in:
        by[cb].append((umi, cnt))
    return {k: (len(v), len({u for u, _ in v if u is not None}), sum(c for _, c in v if c is not None) if any(c is not None for _, c in v) else None) for k, v in by.items()}


def test_totals_with_a_hot_key_nulls_and_clashing_names(make, rows):
    data = [(1, i % 70, 1) for i in range(500)] + [(2, None, 3), (2, 5, None), (None, 7, 2), (None, 7, 2), (3, None, None)]
    df = make([(*r, 9, "k", "v") for r in data], SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in rows(skew.key_totals(skew.value_frequencies(df, "cb", "umi", "cnt")))}
    assert got == profile(data)


def test_weight_that_is_the_value_itself(make, rows):
    df = make([(1, 2, 5, 0, "", ""), (1, 2, 5, 0, "", "")], SCHEMA)
    assert rows(skew.value_frequencies(df, "cb", "cnt", "cnt")) == [(1, 5, 2, 10)]


def test_modes_take_the_smallest_of_ties(make, rows):
    df = make([(1, v, 0, 0, "", "") for v in (4, 4, 2, 2, 9)] + [(2, None, 0, 0, "", ""), (None, 3, 0, 0, "", "")], SCHEMA)
    assert rows(skew.key_modes(skew.value_frequencies(df, "cb", "umi"))) == [(None, 3, 1), (1, 2, 2)]


def nearest_rank(values, p):
    v = sorted(values)
    return v[max(1, -(-p * len(v) // 100)) - 1]


def test_percentiles_equal_nearest_rank_over_wide_and_negative_ranges(make, rows):
    values = {1: [7] * 10, 2: list(range(-50, 1000)), 3: [-(1 << 40), 0, 1 << 40, 5, 5], 4: [None, 3], 5: [(1 << 36) * i for i in range(300)]}
    df = make([(k, v, 0, 0, "", "") for k, vs in values.items() for v in vs], SCHEMA)
    got = {(k, p): v for k, p, v in rows(skew.key_percentiles(skew.value_frequencies(df, "cb", "umi"), (1, 50, 99, 100)))}
    want = {(k, p): nearest_rank([v for v in vs if v is not None], p) for k, vs in values.items() for p in (1, 50, 99, 100)}
    assert got == want


def test_keys_of_nulls_and_empty_tables_give_no_percentiles(make, rows):
    empty = make([], SCHEMA)
    freq = skew.value_frequencies(empty, "cb", "umi")
    assert rows(skew.key_totals(freq)) == rows(skew.key_modes(freq)) == rows(skew.key_percentiles(freq, (50,))) == []
    nulls = skew.value_frequencies(make([(1, None, 0, 0, "", "")], SCHEMA), "cb", "umi")
    assert rows(skew.key_percentiles(nulls, (50,))) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.one_of(st.none(), st.integers(-9, 9))), max_size=40))
def test_frequencies_are_exact(spark, rows, data):
    df = spark.createDataFrame([(*x, 0, 0, "", "") for x in data], SCHEMA)
    assert Counter({(k, v): n for k, v, n in rows(skew.value_frequencies(df, "cb", "umi"))}) == Counter(data)
