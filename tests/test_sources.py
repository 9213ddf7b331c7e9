"""The binary formats, the data source, the text files and streams."""

import hashlib
import io
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.sources import blocks, bus_source, sidecars
from cellweave.sources.records import FIELDS, Header, decode, encode, read_header

SCHEMA = "CB bigint, UMI bigint, EC bigint, COUNT bigint, FLAG bigint"


def columns(rows):
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(FIELDS)}


def test_golden_bytes(spark, tmp_path):
    rows = [(1, 1, 1, 3, 0), (0, 1, 1, 3, 0)]
    assert hashlib.md5(Header("plain", 16, 12).to_bytes() + encode(columns(rows))).hexdigest() == "3b49ecec15ae50a3cf2b7cfd37441ea1"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pos bigint, {SCHEMA}")
    bus_source.write_bus(df, f"{tmp_path}/x.bus", layout="file")
    assert hashlib.md5((tmp_path / "x.bus").read_bytes()).hexdigest() == "3b49ecec15ae50a3cf2b7cfd37441ea1"


def test_header():
    h = read_header(io.BytesIO(Header("plain", 16, 12).to_bytes()))
    assert (h.kind, h.cb_len, h.umi_len, h.start) == ("plain", 16, 12, 49)
    for bad in (b"nope" + bytes(16), b"BUS"):
        with pytest.raises(ValueError):
            read_header(io.BytesIO(bad))
    assert blocks.unpack_header(blocks.pack_header(20, 10)) == (20, 10)
    with pytest.raises(ValueError):
        blocks.pack_header(20, 1 << 30)


def test_stray_bytes_are_passed_over():
    raw = encode(columns([(1, 2, 3, 4, 5)]))
    assert [tuple(r)[:5] for r in decode(raw + b"1234567")] == [(1, 2, 3, 4, 5)]


def test_section_values():
    def values(name, cb, umi):
        return blocks.section_values({"CB": np.array(cb), "UMI": np.array(umi), "COUNT": np.ones(len(cb), int), "FLAG": np.zeros(len(cb), int)})[name].tolist()

    assert values("CB", [0, 0, 1, 1, 1, 1], [0] * 6) == [1, 2, 2, 1, 3]
    assert values("UMI", [0, 0], [0, 0]) == [2, 1, 1]
    assert values("UMI", [0, 0, 0, 1], [10, 10, 10, 0]) == [12, 1, 2, 2]


@pytest.mark.parametrize(
    ("special", "shift", "v"),
    [(0, True, [0, 0, 0]), (0, True, [1, 2, 1]), (0, True, [1, 0, 0, 2, 0, 1, 0]), (1, True, [0, 1, 1, 1, 1, 0]), (1, True, [0, 1, 1]), (0, False, [0, 0, 1, 1]), (1, False, [0, 0, 1, 1]), (1, False, [1, 2, 1, 1]), (0, True, [])],
)
def test_runs(special, shift, v):
    codes = blocks.run_encode(np.array(v, np.uint64), special, shift)
    back, used = blocks.run_decode(codes, special, shift, len(v))
    assert back.tolist() == v and used == len(codes)


def test_fibonacci_codes():
    code = lambda n: "".join(map(str, blocks.fib_encode(np.array([n], np.uint64))))
    assert [code(n) for n in (1, 2, 3, 4)] == ["11", "011", "0011", "1011"]
    with pytest.raises(ValueError):
        blocks.fib_encode(np.array([0], np.uint64))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2**64 - 1), max_size=40))
def test_fibonacci_round_trip(v):
    bits = blocks.from_words(blocks.to_words(blocks.fib_encode(np.array(v, np.uint64)), 8), 8)
    back, _ = blocks.fib_decode(bits, len(v))
    assert back.tolist() == v


def test_patched_block_by_hand():
    """Two exceptions of 16 numbers from 5 to 8: width 2, least 5; 5 + 4 * 3 at place 3 and 6 + 4 * 1 at place 7."""
    v = [5, 6, 7, 17, 8, 5, 6, 10, *[5] * 22]
    raw = blocks.pfd_encode(np.array(v, np.uint64))
    head, ends = blocks.fib_decode(blocks.from_words(raw, 4), 7)
    assert head.tolist() == [2 + 1, 5 + 1, 2 + 1, 3 + 1, 4 + 1, 3, 1]
    start = -(-int(ends[6]) // 32) * 4
    low = blocks.from_words(raw[start:], 4)[:16].reshape(8, 2).tolist()
    assert len(raw) - start == 512 * 2 // 8 and [2 * a + b for a, b in low] == [0, 1, 2, 0, 3, 0, 1, 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 2**32 - 1)), max_size=1100))
def test_patched_round_trip(v):
    raw = blocks.pfd_encode(np.array(v, np.uint64))
    back, used = blocks.pfd_decode(raw + b"\xff" * 8, len(v))
    assert back.tolist() == v and used == len(raw)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**62), st.integers(0, 2**62), st.integers(0, 2**32 - 1), st.integers(1, 2**32 - 1), st.integers(0, 3)), min_size=1, max_size=60))
def test_block_round_trip(rows):
    rows.sort()
    raw = blocks.encode_block(columns(rows))
    n_bytes, n = blocks.unpack_header(raw[:8])
    got = blocks.decode_block(raw[8:], n)
    assert n_bytes == len(raw) - 8 and list(zip(*(got[f].tolist() for f in FIELDS))) == rows


def test_records_a_block_cannot_hold():
    for rows in ([(1, 0, 0, 0, 0)], [(2, 0, 0, 1, 0), (1, 0, 0, 1, 0)], [(1, 2, 0, 1, 0), (1, 1, 0, 1, 0)], [(1, 0, 2**32, 1, 0)]):
        with pytest.raises(ValueError):
            blocks.encode_block(columns(rows))


def data(n):
    return [(i // 7, i % 7 * 3, i * 31 % 5000, 1 + i % 3, i % 2) for i in range(n)]


@pytest.mark.parametrize("suffix", ["bus", "busz"])
@pytest.mark.parametrize(("block", "last"), [("2", "parts"), ("97", "file")])
def test_files(spark, tmp_path, suffix, block, last):
    rows, path = data(700), f"{tmp_path}/x.{suffix}"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pos bigint, {SCHEMA}").repartition(5)
    for layout in ("file", "parts", "parts", "file", "file", last):  # each replaces what is there
        bus_source.write_bus(df, path, 16, 12, block=block, layout=layout)
    back = bus_source.read_bus(spark, path, rows="50")
    assert back.rdd.getNumPartitions() > 5
    assert [tuple(r)[:5] for r in back.orderBy("pos").collect()] == rows
    assert (bus_source.header_of(path).cb_len, bus_source.header_of(path).umi_len) == (16, 12)


def test_conversion_partial_files_and_parts(spark, tmp_path):
    rows = data(300)
    df = spark.createDataFrame(rows, SCHEMA)
    a, b, c, d = (f"{tmp_path}/{n}" for n in ("a.bus", "b.busz", "c.bus", "parts"))
    bus_source.write_bus(df, a, 10, 9, layout="file")
    bus_source.convert(spark, a, b, block="64")
    bus_source.convert(spark, b, c, layout="file")
    assert open(a, "rb").read() == open(c, "rb").read()
    bus_source.write_head(spark, a, c, 10)
    assert [tuple(r)[:5] for r in bus_source.read_bus(spark, c).orderBy("pos").collect()] == sorted(rows)[:10]
    bus_source.write_bus(df, d, layout="parts", codec="blocks")
    assert [tuple(r)[:5] for r in bus_source.read_bus(spark, d).orderBy("CB", "UMI").collect()] == sorted(rows)


def test_compressed_files_without_an_index(spark, tmp_path):
    """They are read by a task each, in order; the index of a path can be made in tasks, and counts from 0 again."""
    import glob
    import os

    rows, path = data(300), f"{tmp_path}/x.busz"
    bus_source.write_bus(spark.createDataFrame(rows, SCHEMA).repartition(3), path, block="10")
    made = {f: open(f, "rb").read() for f in glob.glob(f"{path}/*.idx")}
    for f in made:
        os.remove(f)
    plain = bus_source.read_bus(spark, path, rows="20")
    assert [tuple(r)[:5] for r in plain.orderBy("pos").collect()] == sorted(rows)
    assert {r.end for r in bus_source.plan(path, {"rows": "20"})} == {-1}
    bus_source.index_files(spark, path)
    assert {f: open(f, "rb").read() for f in glob.glob(f"{path}/*.idx")} == made
    back = bus_source.read_bus(spark, path, rows="20")
    assert [r.pos for r in back.orderBy("pos").collect()] == list(range(300)) and len(bus_source.plan(path, {"rows": "20"})) >= 15
    # an index that is not of the file is not used
    for f in made:
        open(f, "ab").write(bus_source.pack_index([(7, 7)]))
    assert bus_source.read_bus(spark, path).count() == 300


def test_files_held_as_bytes(spark, tmp_path):
    rows = data(200)
    for name in ("a.bus", "b.busz"):
        bus_source.write_bus(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/{name}", block="32", layout="file")
    files = spark.read.format("binaryFile").load([f"{tmp_path}/a.bus", f"{tmp_path}/b.busz"])
    got = bus_source.read_bytes(files.unionByName(files.limit(1).selectExpr("path", "modificationTime", "length", "cast(null as binary) as content")))
    for name in ("a.bus", "b.busz"):
        own = got.where(f"path like '%{name}'").orderBy("pos").collect()
        assert [tuple(r)[1:6] for r in own] == sorted(rows) and [r.pos for r in own] == list(range(200))


def test_empty_files_and_errors(spark, tmp_path):
    for s in ("bus", "busz"):
        bus_source.write_bus(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e.{s}")
        assert bus_source.read_bus(spark, f"{tmp_path}/e.{s}").count() == 0
    with pytest.raises(Exception, match="COUNT of 0"):
        bus_source.write_bus(spark.createDataFrame([(1, 1, 1, 0, 0)], SCHEMA), f"{tmp_path}/z.busz")
    with pytest.raises(Exception, match="null"):
        bus_source.write_bus(spark.createDataFrame([(1, None, 1, 0, 0)], SCHEMA), f"{tmp_path}/z.bus")
    with pytest.raises(Exception):
        bus_source.read_bus(spark, f"{tmp_path}/nowhere.bus").count()


def test_long_barcodes_need_wide(spark, tmp_path):
    raw = Header("plain", 32, 12).to_bytes() + struct.pack("<QQIIII", 2**64 - 1, 5, 1, 1, 0, 0)
    (tmp_path / "w.bus").write_bytes(raw)
    with pytest.raises(Exception, match="wide"):
        bus_source.read_bus(spark, f"{tmp_path}/w.bus").count()
    assert int(bus_source.read_bus(spark, f"{tmp_path}/w.bus", wide="true").first().CB) == 2**64 - 1


def test_text_files(spark, tmp_path):
    (tmp_path / "matrix.ec").write_text("0 1,2,3\n1\t3,4\n2 4")
    (tmp_path / "transcripts.txt").write_text("tx0\ntx1\ntx2\ntx3\ntx4\n")
    (tmp_path / "t2g.txt").write_text("tx1 g1 s1 more\ntx2\tg2\ts2\n\n")
    bus_source.write_bus(spark.createDataFrame(data(50), SCHEMA), f"{tmp_path}/output.corrected.sort.bus")
    f = sidecars.BusFolder.of(spark, str(tmp_path))
    assert {r.ec: r.transcripts for r in f.classes().collect()} == {0: [1, 2, 3], 1: [3, 4], 2: [4]}
    assert {r.tx_line: r.tx_name for r in f.transcript_names().collect()} == {i: f"tx{i}" for i in range(5)}
    assert {r.ec: r.names for r in f.gene_mapper(f"{tmp_path}/t2g.txt").classes.collect()} == {0: ["g1", "g2"], 1: [], 2: []}
    assert {r.ec: r.names for r in f.transcript_mapper().classes.collect()}[1] == ["tx3", "tx4"]
    assert (f.n_cells().first()[0], f.n_molecules().first()[0], f.records().count(), f.header().cb_len) == (8, 50, 50, 16)
    (tmp_path / "bad.txt").write_text("tx1 g1\n")
    with pytest.raises(Exception, match="three columns"):
        sidecars.read_t2g(spark, f"{tmp_path}/bad.txt").collect()


def test_streams(spark, tmp_path):
    from cellweave.streaming.groups import closed_groups, running_totals

    path = tmp_path / "s.bus"
    rows = sorted((c, u, 0, 2, 0) for c in range(6) for u in range(5) for _ in range(2))
    path.write_bytes(Header("plain", 16, 12).to_bytes() + encode(columns(rows)))
    spark.dataSource.register(bus_source.BusSource)

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    stream = lambda: spark.readStream.format("bus").option("rows", "11").load(str(path))
    assert {(r.CB, r.n_records, r.n_reads) for r in run(running_totals(stream(), ["CB"]), "complete", "totals")} == {(c, 10, 20) for c in range(6)}
    got = run(closed_groups(stream(), lanes=1), "append", "closed")
    half = tmp_path / "half.bus"
    half.write_bytes(Header("plain", 16, 12).to_bytes() + encode(columns(rows[:31])))
    df = spark.readStream.format("bus").load(str(half))
    q = closed_groups(df, lanes=1).writeStream.format("memory").queryName("grown").outputMode("append").option("checkpointLocation", str(tmp_path / "grown")).start()
    q.processAllAvailable()
    with half.open("ab") as f:
        f.write(encode(columns(rows[31:])))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("grown").collect())) == sorted(map(tuple, got))
    assert [(r.CB, r.UMI, r.n_records, r.n_reads) for r in sorted(got, key=lambda r: (r.CB, r.UMI))] == [(c, u, 2, 4) for c in range(6) for u in range(5)][:-1]
