"""Grouping, classes, consistency, merging, functions."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import arrays, sequences
from cellweave.operators import consistency, grouping, mapping, merge, runs
from cellweave.operators.consistency import Intersector

BUS = "pos bigint, cb bigint, umi bigint, ec bigint, cnt bigint, flag bigint"
#: Classes 0 {A}, 1 {B}, 2 {A,B}, 3 {C,D}, 4 and 5 without genes.
WORLD = [(0, ["A"]), (1, ["B"]), (2, ["A", "B"]), (3, ["C", "D"]), (4, []), (5, [])]


@pytest.fixture
def world(make):
    return make(WORLD, "ec bigint, names array<string>")


def bus(make, ecs, counts=None):
    """One molecule with records of these classes."""
    return make([(i, 1, 1, e, (counts or [1] * len(ecs))[i], 0) for i, e in enumerate(ecs)], BUS)


@pytest.mark.parametrize(
    ("ecs", "status", "genes"),
    [([0], "SingleGene", ["A"]), ([2], "Multimapped", ["A", "B"]), ([0, 2], "SingleGene", ["A"]), ([0, 1], "Inconsistent", []), ([0, 1, 2], "Inconsistent", []), ([4], "Multimapped", []), ([0, 4], "Inconsistent", []), ([4, 4], "Inconsistent", []), ([2, 2], "Multimapped", ["A", "B"])],
)
def test_find_consistent(make, world, ecs, status, genes):
    r = consistency.find_consistent(bus(make, ecs), world, "names").first()
    assert (r.n_records, r.status, r.genes) == (len(ecs), status, genes)


@pytest.mark.parametrize(
    ("ecs", "counts", "want"),
    [([0, 2], [2, 2], [(["A"], 4)]), ([0, 1], [3, 4], [(["A"], 3), (["B"], 4)]), ([4, 5, 0], [1, 1, 1], [([], 1), ([], 1), (["A"], 1)]), ([0, 1, 0, 2], [1, 2, 3, 4], [(["A"], 4), (["B"], 6)])],
)
def test_overlap_classes(make, world, ecs, counts, want):
    got = consistency.overlap_classes(bus(make, ecs, counts), world).collect()
    assert sorted((r.geneset, r.cnt) for r in got) == want


def test_intersector_keys():
    def keys(*sets):
        own = Intersector()
        for s in sets:
            own.add(frozenset(s), 1)
        return [set(k) for k, _ in own.classes]

    assert keys("A", "B") == [{"A"}, {"B"}]
    assert keys("A", "AB") == [{"A"}]
    assert keys("AB", "A", "C") == [{"A"}, {"C"}]


def test_folds_of_random_molecules(make, world, rows):
    r = random.Random(3)
    data = [(i, r.randrange(9), r.randrange(9), r.randrange(6), r.choice([1, 2, None]), 0) for i in range(300)]
    want, sets = {}, dict(WORLD)
    for _, cb, umi, ec, cnt, _ in data:
        want.setdefault((cb, umi), Intersector()).add(frozenset(sets[ec]), cnt or 0)
    got = rows(consistency.overlap_classes(make(data, BUS), world))
    assert sorted((cb, umi, sorted(g), c) for cb, umi, g, c in got) == sorted((*k, sorted(g), c) for k, own in want.items() for g, c in own.classes)


def test_unknown_classes(make, world):
    df = bus(make, [0, 9, None])
    with pytest.raises(Exception, match="unknown class"):
        consistency.find_consistent(df, world, "names").collect()
    assert consistency.find_consistent(df, world, "names", on_missing="drop").first().status == "SingleGene"
    assert consistency.find_consistent(df, world, "names", on_missing="empty").first().status == "Inconsistent"


def test_molecule_counting_modes(make, world, rows):
    df = bus(make, [0, 1, 1], [3, 4, 1])
    count = lambda m, i="ignore": rows(consistency.count_molecules(df, world, m, i))
    assert count("ec") == [(1, 1, "0", 3), (1, 1, "1", 5)]
    assert count("gene") == []
    assert count("gene", "single") == [(1, 1, "", 8)]
    assert count("gene", "distinct") == [(1, 1, "A", 3), (1, 1, "B", 5)]


def test_null_keys_and_empty_tables(make, world, rows):
    df = make([(0, None, 1, 0, 1, 0), (1, 1, None, 0, 1, 0)], BUS)
    empty = make([], BUS)
    for x in (df, empty):
        assert rows(consistency.find_consistent(x, world, "names")) == rows(consistency.overlap_classes(x, world)) == []
    assert rows(grouping.group_totals(df, ["cb"])) == [(None, 1, 1), (1, 1, 1)]
    assert rows(grouping.group_totals(empty, ["cb"])) == rows(grouping.group_records(empty, ["cb"])) == rows(grouping.group_pages(empty, ["cb"])) == []
    assert rows(grouping.n_molecules(df)) == [(0,)]


def test_grouping_keeps_order(make):
    data = [(0, 0, 2, 0, 12, 0), (1, 0, 21, 1, 2, 0), (2, 1, 2, 0, 12, 0), (3, 2, 1, 1, 2, 0), (4, 2, 21, 1, 2, 0), (5, 3, 1, 1, 2, 0)]
    got = {r.cb: [x.pos for x in r.records] for r in grouping.group_records(make(data, BUS), ["cb"]).collect()}
    assert got == {0: [0, 1], 1: [2], 2: [3, 4], 3: [5]}
    assert grouping.n_cells(make(data, BUS)).first()[0] == 4


def test_pages_bound_a_hot_cell(make):
    pages = grouping.group_pages(make([(i, 1, i, 0, 1, 0) for i in range(1000)], BUS), ["cb"], page_rows=64, span=256).collect()
    assert max(len(p.records) for p in pages) <= 64
    assert [x.pos for p in sorted(pages, key=lambda p: p.page) for x in p.records] == list(range(1000))


def test_order_check(make):
    good = make([(i, i // 3, i, 0, 1, 0) for i in range(50)] + [(10_000, 99, 0, 0, 1, 0)], BUS)
    for span in (7, 1 << 20):
        assert grouping.check_sorted(good, ["cb"], span=span).count() == 51
    bad = make([(0, 0, 2, 0, 1, 0), (1, 0, 21, 0, 1, 0), (2, 2, 2, 0, 1, 0), (3000, 0, 1, 0, 1, 0)], BUS)
    for span in (2, 1 << 20):
        with pytest.raises(Exception, match="Unsorted busfile: 2 -> 0"):
            grouping.check_sorted(bad, ["cb"], span=span).collect()
    with pytest.raises(Exception, match=r"Unsorted busfile: \(2, 2\) -> \(0, 1\)"):
        grouping.check_sorted(bad, ["cb", "umi"]).collect()


MATRIX = "line_no bigint, ec bigint, transcripts array<bigint>"


def test_gene_and_transcript_mappers(make, rows):
    matrix = make([(0, 0, [0, 1]), (1, 1, [2]), (2, 2, [3]), (3, 0, [0, 2]), (4, 3, [])], MATRIX)
    tx = make([(0, "tB"), (1, "tA"), (2, "tC"), (3, "tD")], "tx_line bigint, tx_name string")
    t2g = make([("tB", "g2", "s"), ("tA", "g9", None), ("tC", "g1", "s")], "tx_name string, gene string, symbol string")
    m = mapping.gene_mapper(matrix, tx, t2g)
    assert {r.ec: (r.ids, r.names) for r in m.classes.collect()} == {0: ([0, 1], ["g1", "g2"]), 1: ([0], ["g1"]), 2: ([], []), 3: ([], [])}
    assert [tuple(r) for r in m.listing().collect()] == [(0, "g1"), (1, "g2")]
    t = mapping.transcript_mapper(matrix, tx)
    assert {r.ec: r.names for r in t.classes.collect()} == {0: ["tB", "tC"], 1: ["tC"], 2: ["tD"], 3: []}
    assert [tuple(r) for r in t.listing().collect()] == [(0, "tB"), (1, "tC"), (2, "tD")]  # ranks of names in use, not lines
    ids = make([(1,), (7,)], "id bigint")
    assert rows(m.resolve(ids)) == [(1, "g2"), (7, None)]
    assert rows(m.names_of(make([(1,), (8,)], "ec bigint"))) == [(1, ["g1"]), (8, None)]


def test_mapper_errors(make):
    tx = make([(0, "a")], "tx_line bigint, tx_name string")
    t2g = make([("a", "g", ""), ("a", "h", "")], "tx_name string, gene string, symbol string")
    with pytest.raises(Exception, match="duplicate transcript"):
        mapping.gene_mapper(make([(0, 0, [0])], MATRIX), tx, t2g).classes.collect()
    with pytest.raises(Exception, match="unknown transcript"):
        mapping.transcript_mapper(make([(0, 0, [5])], MATRIX), tx).classes.collect()
    assert mapping.gene_mapper(make([(0, 0, [0, 5])], MATRIX), tx, t2g, "drop", "first").classes.first().names == ["g"]


def test_merge(make):
    t1 = make([(0, 0, 21, 0, 2, 0), (1, 1, 2, 0, 12, 0), (2, 1, 3, 0, 2, 0), (3, 3, 0, 0, 2, 0)], BUS)
    t2 = make([(0, 0, 1, 1, 2, 0), (1, 1, 2, 1, 12, 0), (2, 2, 3, 1, 2, 0)], BUS)
    all_ = merge.tagged({"t1": t1, "t2": t2, "none": make([], BUS)})
    got = {r.cb: {k: [x.pos for x in v] for k, v in r.records.items()} for r in merge.merge_records(all_, ["cb"]).collect()}
    assert got == {0: {"t1": [0], "t2": [0]}, 1: {"t1": [1, 2], "t2": [1]}, 2: {"t2": [2]}, 3: {"t1": [3]}}
    totals = merge.merge_totals(all_, ["cb"])
    assert {r.cb: {k: tuple(v) for k, v in r.totals.items()} for r in totals.collect()}[1] == {"t1": (2, 14), "t2": (1, 12)}
    assert [r.cb for r in merge.in_samples(totals, "totals", ["t1"], ["t2"]).collect()] == [3]


def test_sequences(make):
    df = make([(0, 1, "A"), (3, 1, "T"), (1, 3, "AAC"), (4, 2, "CA"), (148, 4, "GCCA"), (148, 2, "GCCA"), (2**62 - 1, 31, "T" * 31)], "n bigint, k int, s string")
    for r in df.select("s", sequences.decode_sequence(F.col("n"), F.col("k")).alias("got"), "n", sequences.encode_sequence(F.col("s")).alias("back")).collect():
        assert (r.got, r.back) == (r.s, r.n)
    bad = make([("ACN",), ("",), ("A" * 32,), (None,)], "s string")
    assert [x[0] for x in bad.select(sequences.encode_sequence(F.col("s"), "null")).collect()] == [None] * 4
    with pytest.raises(Exception, match="not a sequence"):
        bad.select(sequences.encode_sequence(F.col("s"))).collect()


def test_arrays(make):
    def one(v, f, kind="bigint"):
        return make([(v,)], f"v array<{kind}>").select(f(F.col("v")).alias("x")).first()[0]

    assert one([3, 1, 2, 1], arrays.argsort) == [1, 3, 2, 0]
    assert one([3.0, 1.0, 1.0], lambda v: arrays.argsort_floats(v, True), "double") == [0, 2, 1]
    assert one([3.0, 1.0, 1.0], lambda v: arrays.argsort_floats(v, False), "double") == [1, 2, 0]
    assert tuple(one([1, -1, 10, 0], arrays.argmin)) == (1, -1) and tuple(one([1, -1, 10, 0], arrays.argmax)) == (2, 10)
    assert tuple(one([5, 5], arrays.argmax)) == (1, 5) and tuple(one([5, 5], arrays.argmin)) == (0, 5)
    for v, want in (([4, 3, 2, 1], (1, [3])), ([4, 1, 2, 1], (1, [1, 3])), ([4, 2, 3, 2, 1, 2, 1, 4], (1, [4, 6]))):
        assert tuple(one(v, arrays.min_argmin)) == want
    assert one([], arrays.argmax) is None and one([], arrays.min_argmin) is None and one([2, 1, 2], arrays.as_set) == [1, 2]
    with pytest.raises(Exception, match="NaN"):
        one([float("nan")], lambda v: arrays.argsort_floats(v, True), "double")


def test_runs_and_deltas(make, rows):
    data = [(i, c, u, 0, 1, 0) for i, (c, u) in enumerate([(0, 10), (0, 10), (0, 10), (1, 0), (1, 7), (4, 7), (4, 9)])]
    for block in (2, 100):
        d = runs.deltas(runs.with_block(make(data, BUS), block))
        back = runs.undo_deltas(d.select("block", "pos", "d_cb", "d_umi"))
        assert rows(back.select("pos", "cb", "umi")) == [x[:3] for x in data]
        r = runs.runs_of(d, "d_cb", 0)
        assert rows(runs.undo_runs(r)) == rows(d.select("block", "pos", "d_cb"))
    assert rows(runs.runs_of(runs.deltas(runs.with_block(make(data, BUS), 100)), "d_cb", 0))[0] == (0, 0, 0, 3)
