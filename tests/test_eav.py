from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.operators import eav
from cellweave.operators.eav import Field

A = "row_no bigint, rec_id bigint, attr string, attr_val string, written_at timestamp_ntz, field string, entity string, value string"
TERMS = [("CB", "CB"), ("cell barcode", "CB"), ("EC", "EC"), ("eq class", "EC"), ("COUNT", "COUNT"), ("n reads", "COUNT"), ("UMI", "UMI")]
T0, T1 = datetime(2020, 1, 1), datetime(2020, 1, 2)

NUMBERS = {
    "12": 12, " 12\t\n": 12, '"12"': 12, "+12": 12, "12.0": 12, "12.": 12, "1.2e1": 12, "1.2E+1": 12, "120e-1": 12, "0x1F": 31, "0X1f": 31, "1,234": 1234, "4,294,967,295": 4294967295,
    "4294967296": None, "-1": None, "-0": 0, "12.5": None, "1e": None, "0xZZ": None, "twelve": None, "~40": None, ">9": None, "3;4": None, "12-15": None, "1 or 2": None, "12,34": None, "1,23,456": None,
    "": None, " ": None, "NaN": None, "null": None, "1_000": None, "--": None, "1" * 60: None, "0" * 30 + "7": 7, "1e99": None, "ACGT": None, "1.00000000000000000001": None, "5." + "0" * 19: 5, "12e0": 12, "1,000e-3": 1, "1,5": None, "0e99999999999": 0, "7e-99999999999": None, "0." + "0" * 40: 0, "0.00000000000000000000000000012e29": 12,
    "4294967295" + "0" * 30 + "e-30": 4294967295, "1e9": 10**9, "1e10": None, "+0.5e1": 5, "-0.0": 0, "-0.5e1": None, "1.e1": 10, ".5e1": None, "10e-1": 1, "105e-1": None, None: None, "x" * 100_000: None,
}


def test_whole_numbers(make):
    df = make([(k,) for k in NUMBERS], "v string")
    out = eav.with_whole_number(df, "v", "n", F.expr(f"{eav.U32_MAX}BD"), F.lit(False))
    assert {r.v: r.n for r in out.collect()} == NUMBERS


def test_bases_and_numbers_of_64_bits(make):
    given = {"GCCA": 148, " acgt ": 27, '"TTTT"': 255, "A": 0, "T" * 31: 2**62 - 1, "T" * 32: -1, "T" * 33: None, "ACGN": None, "18446744073709551615": -1, "9223372036854775808": -(2**63), "18446744073709551616": None, "0xFFFFFFFFFFFFFFFF": -1}
    df = make([(k,) for k in given], "v string")
    out = eav.with_whole_number(df, "v", "n", F.expr(f"{eav.U64_MAX}BD"), F.lit(True))
    assert {r.v: r.n for r in out.collect()} == given


def wide(make, attrs):
    df = make([(*a, "f", "e", "v") for a in attrs], A)
    return {r.rec_id: (r.cb, r.ec, r.cnt) for r in eav.bus_records_wide(df, make(TERMS, "term string, field string")).collect()}


def test_latest_usable_value_holds_and_ties_go_to_the_larger_row(make):
    attrs = [
        (1, 1, "CB", "5", T0), (2, 1, "Cell-Barcode", "6", T1), (3, 1, "c.b.", "junk", T1), (4, 1, "EC", "1", T0), (5, 1, "eq_class", "2", T0), (6, 1, " N reads", "0x3", T0),
        (7, 2, "cb_len", "16", T0), (8, 3, "UMI", "9", T0), (9, 4, "EC", "7", None), (10, 4, "EC", "8", T0), (11, None, "EC", "8", T0), (12, 5, None, "8", T0), (13, 6, "CB", None, T0), (6, 1, " N reads", "0x3", T0),
    ]
    assert wide(make, attrs) == {1: (6, 2, 3), 2: (None, None, None), 3: (None, None, None), 4: (None, 8, None), 5: (None, None, None), 6: (None, None, None)}


def test_a_record_rewritten_very_often(make):
    attrs = [(i, 1, "EC", str(i), T0) for i in range(5000)] + [(9000 + i, i + 2, "CB", str(i), T0) for i in range(50)]
    got = wide(make, attrs)
    assert got[1] == (None, 4999, None) and len(got) == 51 and got[7] == (5, None, None)


def test_empty_tables(make):
    assert wide(make, []) == {}


def test_scatter_joins_entities_cut_by_batches_and_types():
    fields = (Field("a", "a"), Field("b", "b", "double"), Field("c", "c", "string"))
    long = [(1, "a", 1, None, None), (1, "b", None, 2.5, None), (1, "zz", 9, None, None), (2, "c", None, None, "x"), (2, "a", 7, None, None), (3, "b", None, None, None), (4, None, 1, None, None)]
    names = ["entity", "attribute", "v_bigint", "v_double", "v_string"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string()]
    want = [(1, 1, 2.5, None), (2, 7, None, "x"), (3, None, None, None), (4, None, None, None)]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*long[i : i + size]), types)], names=names) for i in range(0, len(long), size)]
        got = [tuple(r.values()) for b in eav.scatter(iter(batches), fields) for r in b.to_pylist()]
        assert got == want, size


def test_widen_of_mixed_types(make, rows):
    df = make([(1, "x", 1, None), (1, "y", None, "s"), (2, "y", None, "t"), (None, "x", 3, None)], "entity bigint, attribute string, v_bigint bigint, v_string string")
    assert rows(eav.widen(df, [Field("x", "x"), Field("y", "why", "string")])) == [(1, 1, "s"), (2, None, "t")]


def test_widen_casts_a_plain_value_to_each_type(make, rows):
    df = make([(1, "x", "7"), (1, "y", "2.5"), (1, "z", "t"), (2, "x", "no")], "entity bigint, attribute string, value string")
    assert rows(eav.widen(df, [Field("x", "x"), Field("y", "y", "double"), Field("z", "z", "string")])) == [(1, 7, 2.5, "t"), (2, None, None, None)]


@pytest.mark.parametrize("name", ["Cell Barcode", "cell_barcode", "CELL-BARCODE", " cellbarcode "])
def test_spellings(make, name):
    assert make([(name,)], "a string").select(eav.name_key(F.col("a"))).first()[0] == "cellbarcode"
