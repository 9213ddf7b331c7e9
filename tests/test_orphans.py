import random
from collections import Counter
from datetime import datetime, timedelta

from cellweave.operators.orphans import Child, Parent, orphan_references, orphan_report

C = "ec bigint, at timestamp_ntz, parent string, key string, period bigint"
P = "ec bigint, since timestamp_ntz, until timestamp_ntz, n bigint, child string"
T0 = datetime(2020, 3, 1)


def run(make, children, parents):
    c, p = make([(*x, "x", "y", 1) for x in children], C), make([(*x, 4, "z") for x in parents], P)
    return orphan_references([Child("c", c, "ec", "at", "p")], [Parent("p", p, "ec", "since", "until")])


def brute(children, parents):
    out = Counter()
    for ec, at in children:
        if ec is None:
            continue
        own = [p for p in parents if p[0] == ec and p[1] is not None and (p[2] is None or p[2] > p[1])]
        if at is None:
            out[("c", "p", None, ec, "missing")] += 1
        elif not any(p[1] <= at and (p[2] is None or at < p[2]) for p in own):
            reason = "missing" if not own else "added_later" if min(p[1] for p in own) > at else "removed"
            out[("c", "p", at.strftime("%Y-%m-%d"), ec, reason)] += 1
    return out


def check(make, children, parents):
    got = {tuple(r)[:5]: r["n"] for r in run(make, children, parents).collect()}
    assert got == dict(brute(children, parents))


def test_validity_is_exact_to_the_microsecond(make):
    on, off = T0 + timedelta(hours=5, microseconds=7), T0 + timedelta(hours=5, seconds=3)
    us = timedelta(microseconds=1)
    check(make, [(1, x) for x in (on - us, on, on + us, off - us, off, off + us, T0 + timedelta(days=3))], [(1, on, off)])


def test_gaps_overlaps_repeated_and_impossible_parents(make):
    d = timedelta(days=1)
    parents = [(1, T0, T0 + d), (1, T0, T0 + d), (1, T0 + 2 * d, None), (2, T0 + d, T0), (3, None, None), (None, T0, None), (4, T0 + d, T0 + d)]
    check(make, [(k, T0 + i * d / 4) for k in (1, 2, 3, 4, 5, None) for i in range(-3, 14)], parents)


def test_null_times_and_repeated_rows_count(make):
    check(make, [(1, None), (1, None), (2, T0), (2, T0), (None, None)], [(1, T0, None)])


def test_random_against_brute_force(make):
    r = random.Random(5)
    moment = lambda: T0 + timedelta(seconds=r.randrange(4 * 86400), microseconds=r.choice([0, 1, 999_999]))
    parents = [(r.randrange(6), moment(), r.choice([None, moment()])) for _ in range(25)]
    children = [(r.choice([0, 0, 0, 0, 1, 2, 3, 7]), moment()) for _ in range(400)] + [(p[0], p[1]) for p in parents]
    check(make, children, parents)


def test_times_before_1970(make):
    old = datetime(1969, 12, 30, 23, 59, 59)
    check(make, [(1, old), (1, old + timedelta(days=1))], [(1, old + timedelta(hours=1), None)])


def test_empty_tables_and_report(make):
    assert run(make, [], []).collect() == []
    assert run(make, [], [(1, T0, None)]).collect() == []
    lone = run(make, [(1, T0), (1, T0), (2, T0)], [])
    assert [tuple(x) for x in orphan_report(lone).collect()] == [("c", "p", "2020-03-01", "missing", 3, 2)]
