from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.llm import heavy as H

SCHEMA = "cb bigint, cnt bigint, key bigint, weight bigint, total bigint, w bigint"


def sketch_of(pairs, rows, cols):
    s = H.VoteSketch(rows, cols)
    for i in range(0, len(pairs), 7):
        part = pairs[i : i + 7]
        s.add(np.array([k for k, _ in part], np.int64), np.array([w for _, w in part], np.int64))
    return s


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 30), st.integers(1, 50)), max_size=80))
def test_bounds_hold_for_every_key_even_in_a_tiny_sketch(pairs):
    true = Counter()
    for k, w in pairs:
        true[k] += w
    s = sketch_of(pairs, 2, 3)
    for r in range(2):
        assert s.total[r].sum() == sum(true.values())
        for k, w in true.items():
            c = H.cell_of(np.array([k]), r, 3)[0]
            own = s.candidate[r, c] == k and s.total[r, c] > 0
            assert w <= (s.total[r, c] + (1 if own else -1) * s.surplus[r, c]) // 2
            if own:
                assert s.surplus[r, c] <= w
            if 2 * w > s.total[r, c]:
                assert own


def run(make, data, share, **kw):
    return H.heavy_hitters(make([(k, w, 1, 2, 3, 4) for k, w in data], SCHEMA), "cb", "cnt", share, **kw)


def test_heavy_keys_are_found_and_only_those(make):
    data = [(k, 1) for k in range(3000)] + [(-7, 40)] * 10 + [(5_000_000_000, 300), (9, 99)]
    total = sum(w for _, w in data)
    true = Counter()
    for k, w in data:
        true[k] += w
    for cols in (4096, 64):
        got = run(make, data, 0.05, cols=cols).collect()
        assert {r.key: r.w if "w" in r else r.weight for r in got} == {k: w for k, w in true.items() if w >= 0.05 * total}
        assert all(r.lower <= r.weight <= r.upper and r.total == total for r in got)


def test_candidates_without_the_exact_pass_include_all_heavy(make):
    got = {r.key: (r.lower, r.upper) for r in run(make, [(1, 60), (2, 30), (3, 10)], 0.25, exact=False).collect()}
    assert {1, 2} <= set(got) and got[1][0] <= 60 <= got[1][1]


def test_nulls_zeros_and_empty_tables(make):
    data = [(None, 80), (1, 20), (2, None), (3, 0), (4, -5)]
    assert [(r.key, r.weight, r.total) for r in run(make, data, 0.2).collect()] == [(1, 20, 100)]
    assert run(make, [], 0.1).collect() == run(make, [(None, 5)], 0.1).collect() == []


def test_sketches_of_parts_merge_in_any_order(make):
    a, b = ([(k, 1 + k % 5) for k in range(s, 400)] + [(7, 500)] for s in (0, 200))
    cells = [H.vote_cells(make([(k, w, 0, 0, 0, 0) for k, w in x], SCHEMA), F.col("cb"), F.col("cnt"), 2, 32) for x in (a, b)]
    for parts in (cells, cells[::-1]):
        found = H.heavy_candidates(H.merge_cells(parts[0].unionByName(parts[1])), 0.2, 2, 32).collect()
        true = sum(w for k, w in a + b if k == 7)
        assert any(r.key == 7 and r.lower <= true <= r.upper for r in found)
