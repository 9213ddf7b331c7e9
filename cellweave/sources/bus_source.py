"""A Spark data source for the plain and the block-compressed record format.

    spark.dataSource.register(BusSource)
    spark.read.format("bus").load("cells.bus")
    df.write.format("bus").option("cb_len", 16).option("umi_len", 12).save("cells.busz")

Paths ending in .busz are block-compressed, others plain, unless ``codec`` says plain or blocks. A
path may be a file or a folder of files. Options of reading: wide (true: CB and UMI as
decimal(20,0), for lengths of 32), rows (records a partition), head (only partitions with one of
that many first records need be read). Of writing: cb_len, umi_len,
block (records a block), layout (``parts``: a folder with a complete file for each task;
``file``: one file, which the driver makes of the tasks' parts in order of their first pos or key,
so for results of moderate size only).

Beside each compressed file stands its index, name and ``.idx``: where its blocks begin and how
many records they hold. Files with an index are cut into partitions by it; index_files() makes
those of other files, in tasks. A compressed file without one is read by one task, which walks its
blocks. pos counts the records of a path from 0; if the numbers of records of earlier compressed
files are not known, files begin at multiples of 2**40.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import blocks
from .records import DDL, LONGEST, RECORD_BYTES, WIDE_DDL, Header, decode, encode, from_batch, read_header, to_batch

ROWS, BLOCK, BATCH = 2_000_000, 100_000, 65_536
SUFFIXES, INDEX = (".bus", ".busz"), ".idx"
#: Positions apart at which files begin whose numbers of records are not known.
APART = 1 << 40
#: Files whose headers are read at once when partitions are planned.
AT_ONCE = 32


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The files a path names: itself, or those of a folder in order of their names."""
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(inner)]
    return [prefix + x.path for x in sorted(system.get_file_info(pafs.FileSelector(inner)), key=lambda x: x.path) if x.path.endswith(SUFFIXES)]


def codec_of(path: str, options: dict) -> str:
    codec = options.get("codec", "")
    if codec in ("plain", "blocks"):
        return codec
    if codec:
        raise ValueError(f"codec must be plain or blocks, not {codec}")
    return "blocks" if path.rstrip("/").endswith(".busz") else "plain"


def header_of(path: str) -> Header:
    """The header of a file: its barcode and identifier lengths, among others."""
    system, inner = file_system(files_of(path)[0])
    with system.open_input_stream(inner) as f:
        return read_header(f)


@dataclass
class Range(InputPartition):
    """Records of a file: bytes from ``start`` to ``end`` (-1: as far as its end mark), the first having the ordinal ``first``."""

    path: str
    kind: str
    start: int
    end: int
    first: int
    wide: bool


def walk(f: pa.NativeFile, start: int, name: str) -> Iterator[tuple[int, int]]:
    """(offset, records) of every block of a compressed file, by their headers; at last the offset of the end mark, with 0."""
    at = start
    while True:
        f.seek(at)
        raw = f.read(8)
        if len(raw) < 8:
            raise ValueError(f"{name} has no end mark")
        n_bytes, n = blocks.unpack_header(raw)
        yield at, n
        if (n_bytes, n) == (0, 0):
            return
        at += 8 + n_bytes


def pack_index(rows: list[tuple[int, int]]) -> bytes:
    """Offsets and numbers of records of blocks, and of the end mark, as pairs of 8 bytes."""
    return np.array(rows, "<i8").tobytes()


def _check_sub_header(f: pa.NativeFile) -> None:
    _, pfd, lossy = struct.unpack(blocks.SUB_HEADER, f.read(blocks.SUB_HEADER_BYTES))
    if pfd != blocks.PFD_BLOCK or lossy:
        raise ValueError("only patched blocks of 512 and lossless identifiers can be read")


@dataclass(frozen=True)
class _Known:
    """What is known of a file without reading its records."""

    start: int
    size: int
    index: np.ndarray | None


def _known(name: str, kind: str, wide: bool) -> _Known:
    system, inner = file_system(name)
    with system.open_input_file(inner) as f:
        head, size = read_header(f), f.size()
        if head.kind != kind:
            raise ValueError(f"{name} is {head.kind}, not {kind}")
        if not wide and max(head.cb_len, head.umi_len) > LONGEST:
            raise ValueError("sequences of more than 31 bases need wide=true")
        if kind == "plain":
            return _Known(head.start, size, None)
        _check_sub_header(f)
    index = None
    if system.get_file_info(inner + INDEX).type == pafs.FileType.File:
        with system.open_input_stream(inner + INDEX) as f:
            index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
        if not len(index) or index[-1, 0] + 8 != size:
            index = None  # of another file
    return _Known(head.start + blocks.SUB_HEADER_BYTES, size, index)


def plan(path: str, options: dict) -> list[Range]:
    """Partitions of a path, of about ``rows`` records. Of every file its header is read, and its index; no blocks are walked."""
    rows, wide, out, first = int(options.get("rows", ROWS)), str(options.get("wide", "false")).lower() == "true", [], 0
    names = files_of(path)
    kinds = [codec_of(name, options) for name in names]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        known = list(pool.map(lambda x: _known(*x, wide), zip(names, kinds)))
    for name, kind, k in zip(names, kinds, known):
        if kind == "plain":
            n = (k.size - k.start) // RECORD_BYTES
            for i in range(0, n, rows):
                m = min(rows, n - i)
                out.append(Range(name, kind, k.start + i * RECORD_BYTES, k.start + (i + m) * RECORD_BYTES, first + i, wide))
            first += n
        elif k.index is None:
            out.append(Range(name, kind, k.start, -1, first, wide))
            first = (first // APART + 1) * APART
        else:
            at, upto = k.index[:, 0], np.r_[0, np.cumsum(k.index[:-1, 1])]
            i, last = 0, len(at) - 1
            while i < last:
                j = min(last, max(i + 1, int(np.searchsorted(upto, upto[i] + rows))))
                out.append(Range(name, kind, int(at[i]), int(at[j]), first + int(upto[i]), wide))
                i = j
            first += int(upto[-1])
    if head := int(options.get("head", 0)):  # where all numbers are known, ranges beyond are not read
        out = [r for r in out if r.first < head] if all(r.end >= 0 for r in out) else out
    return out


def index_files(spark: SparkSession, path: str) -> None:
    """Writes the indexes of the compressed files of a path that have none; a task a file walks the headers of its blocks."""
    missing = []
    for name in files_of(path):
        system, inner = file_system(name)
        if codec_of(name, {}) == "blocks" and system.get_file_info(inner + INDEX).type == pafs.FileType.NotFound:
            missing.append((name,))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                system, inner = file_system(name)
                with system.open_input_file(inner) as f:
                    head = read_header(f)
                    _check_sub_header(f)
                    rows = list(walk(f, head.start + blocks.SUB_HEADER_BYTES, name))
                with system.open_output_stream(inner + INDEX) as f:
                    f.write(pack_index(rows))
            yield b

    if missing:
        spark.createDataFrame(missing, "name string").repartition(len(missing)).mapInArrow(each, "name string").write.format("noop").mode("overwrite").save()


def read_range(r: Range) -> Iterator[pa.RecordBatch]:
    """The records of a partition, in batches."""
    system, inner = file_system(r.path)
    first, at = r.first, r.start
    with system.open_input_file(inner) as f:
        while at < r.end or r.end < 0:
            f.seek(at)
            if r.kind == "plain":
                raw = f.read(min(BATCH * RECORD_BYTES, r.end - at))
                rec, at = decode(raw), at + len(raw)
                columns = {n: rec[n] for n in rec.dtype.names}
            else:
                raw = f.read(8)
                if len(raw) < 8:
                    raise ValueError(f"{r.path} has no end mark")
                n_bytes, n = blocks.unpack_header(raw)
                if (n_bytes, n) == (0, 0):
                    return
                columns, at = blocks.decode_block(f.read(n_bytes), n), at + 8 + n_bytes
            n = len(columns["CB"])
            for i in range(0, n, BATCH):
                yield to_batch({k: v[i : i + BATCH] for k, v in columns.items()}, first + i, r.wide)
            first += n


class BusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Range]:
        return plan(self.options["path"], self.options) or [Range("", "plain", 0, 0, 0, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if partition.path else iter(())


class BusStreamReader(DataSourceStreamReader):
    """Reads what was appended to a plain file; offsets are ordinals of records, partitions ranges of them."""

    def __init__(self, options: dict):
        self.options, self.ranges, self.upto = dict(options), [], -1

    def _plan(self) -> list[Range]:
        ranges = plan(self.options["path"], self.options)
        if any(r.kind != "plain" for r in ranges):
            raise ValueError("only plain files can be read as a stream")
        return ranges

    def initialOffset(self) -> dict:
        return {"record": 0}

    def latestOffset(self) -> dict:
        self.ranges = self._plan()
        last = self.ranges[-1] if self.ranges else None
        self.upto = last.first + (last.end - last.start) // RECORD_BYTES if last else 0
        return {"record": self.upto}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if end["record"] > self.upto:  # after a restart; else the plan of latestOffset() holds
            self.latestOffset()
        out = []
        for r in self.ranges:
            a, b = max(start["record"], r.first), min(end["record"], r.first + (r.end - r.start) // RECORD_BYTES)
            if a < b:
                out.append(Range(r.path, r.kind, r.start + (a - r.first) * RECORD_BYTES, r.start + (b - r.first) * RECORD_BYTES, a, r.wide))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


@dataclass
class Written(WriterCommitMessage):
    part: str
    order: tuple
    n: int


class BusWriter(DataSourceArrowWriter):
    """Writes a part for each task; the driver puts them together, or leaves them as complete files."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.options, self.overwrite = options["path"], dict(options), overwrite
        self.kind, self.parts = codec_of(self.path, options), options.get("layout", "parts") == "parts"
        self.header = Header(self.kind, int(options.get("cb_len", 16)), int(options.get("umi_len", 12)))
        self.block, self.id = int(options.get("block", BLOCK)), uuid.uuid4().hex
        system, inner = file_system(self.path)
        # complete files are written in place, unless a file must make way for their folder
        self.folder = inner if self.parts and system.get_file_info(inner).type != pafs.FileType.File else f"{inner}.{self.id}"
        if max(self.header.cb_len, self.header.umi_len) > 32:
            raise ValueError("sequences can have 32 bases at most")

    def _lead(self) -> bytes:
        sub = struct.pack(blocks.SUB_HEADER, self.block, blocks.PFD_BLOCK, 0) if self.kind == "blocks" else b""
        return self.header.to_bytes() + sub

    def _end(self) -> bytes:
        return bytes(8) if self.kind == "blocks" else b""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, inner = file_system(self.path)
        folder = self.folder
        system.create_dir(folder, recursive=True)
        suffix = ".busz" if self.kind == "blocks" else ".bus"
        part = f"{folder}/part-{context.partitionId():08d}-{self.id}-{context.taskAttemptId()}{suffix}"
        n, order, held, index = 0, (), None, []

        def put(f: pa.NativeFile, columns: dict[str, np.ndarray]) -> None:
            index.append((f.tell(), len(columns["CB"])))
            f.write(blocks.encode_block(columns))

        with system.open_output_stream(part) as f:
            if self.parts:
                f.write(self._lead())
            for batch in iterator:
                if not batch.num_rows:
                    continue
                columns = from_batch(batch)
                if not n:
                    names = {x.lower(): x for x in batch.schema.names}
                    order = (batch.column(names["pos"])[0].as_py(),) if "pos" in names else tuple(int(columns[c][0]) for c in ("CB", "UMI", "EC"))
                n += batch.num_rows
                if self.kind == "plain":
                    f.write(encode(columns))
                    continue
                held = columns if held is None else {k: np.concatenate([held[k], columns[k]]) for k in columns}
                while len(held["CB"]) >= self.block:
                    put(f, {k: v[: self.block] for k, v in held.items()})
                    held = {k: v[self.block :] for k, v in held.items()}
            if held is not None and len(held["CB"]):
                put(f, held)
            index.append((f.tell(), 0))
            if self.parts:
                f.write(self._end())
        if self.kind == "blocks":
            with system.open_output_stream(part + INDEX) as f:
                f.write(pack_index(index))
        return Written(part, order, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = file_system(self.path)
        done = [m for m in messages if m is not None]
        if self.parts:
            if self.folder != inner:
                system.delete_file(inner)
                if done:
                    system.move(self.folder, inner)
                return
            if self.overwrite:
                keep = {m.part for m in done} | {m.part + INDEX for m in done}
                for x in system.get_file_info(pafs.FileSelector(inner)):
                    if x.path not in keep and x.path.endswith((*SUFFIXES, INDEX)):
                        system.delete_file(x.path)
            return
        temporary, index = f"{inner}.{self.id}.new", []
        with system.open_output_stream(temporary) as out:
            out.write(self._lead())
            for m in sorted((m for m in done if m.n), key=lambda m: m.order):
                if self.kind == "blocks":
                    with system.open_input_stream(m.part + INDEX) as f:
                        index += [(out.tell() + at, n) for at, n in np.frombuffer(f.read(), "<i8").reshape(-1, 2)[:-1].tolist()]
                with system.open_input_stream(m.part) as f:
                    while chunk := f.read(1 << 22):
                        out.write(chunk)
            index.append((out.tell(), 0))
            out.write(self._end())
        if system.get_file_info(inner).type == pafs.FileType.Directory:
            system.delete_dir(inner)
        system.move(temporary, inner)
        if self.kind == "blocks":
            with system.open_output_stream(inner + INDEX) as f:
                f.write(pack_index(index))
        self._clean(system, inner)

    def _clean(self, system: pafs.FileSystem, inner: str) -> None:
        if system.get_file_info(f"{inner}.{self.id}").type == pafs.FileType.Directory:
            system.delete_dir(f"{inner}.{self.id}")

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = file_system(self.path)
        for m in messages:
            if m is not None and self.parts:
                for name in (m.part, m.part + INDEX):
                    if system.get_file_info(name).type == pafs.FileType.File:
                        system.delete_file(name)
        if not self.parts:
            self._clean(system, inner)


class BusSource(DataSource):
    """The data source ``bus``."""

    @classmethod
    def name(cls) -> str:
        return "bus"

    def schema(self) -> str:
        return WIDE_DDL if str(self.options.get("wide", "false")).lower() == "true" else DDL

    def reader(self, schema: StructType) -> BusReader:
        return BusReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BusWriter:
        return BusWriter(self.options, overwrite)

    def streamReader(self, schema: StructType) -> BusStreamReader:
        return BusStreamReader(self.options)


def records_of(raw: bytes, wide: bool = False) -> Iterator[pa.RecordBatch]:
    """The records of a whole file held as bytes, of either kind."""
    f = io.BytesIO(raw)
    head, first = read_header(f), 0
    if head.kind == "plain":
        rec = decode(raw[head.start :])
        for i in range(0, len(rec), BATCH):
            part = rec[i : i + BATCH]
            yield to_batch({n: part[n] for n in part.dtype.names}, i, wide)
        return
    f.read(blocks.SUB_HEADER_BYTES)
    while True:
        mark = f.read(8)
        if len(mark) < 8:
            raise ValueError("the bytes have no end mark")
        n_bytes, n = blocks.unpack_header(mark)
        if (n_bytes, n) == (0, 0):
            return
        yield to_batch(blocks.decode_block(f.read(n_bytes), n), first, wide)
        first += n


def read_bytes(files: DataFrame) -> DataFrame:
    """(path, CB, ..., pos) of files held in rows (path, content), as ``spark.read.format("binaryFile")`` gives them. Null contents have no records."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                for r in records_of(raw.as_py()) if raw.is_valid else ():
                    yield pa.RecordBatch.from_arrays([pa.array([path] * r.num_rows, pa.string()), *r.columns], names=["path", *r.schema.names])

    return files.select("path", "content").mapInArrow(each, f"path string, {DDL}")


def read_bus(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of a file or folder, with their ordinals in pos."""
    spark.dataSource.register(BusSource)
    return spark.read.format("bus").options(**options).load(path)


def write_bus(df: DataFrame, path: str, cb_len: int = 16, umi_len: int = 12, order: list[str] | None = None, **options: str) -> None:
    """Writes records in order of ``order`` (pos if there is one, else CB, UMI, EC), replacing what is at ``path``.

    Compressed files need records in order of CB and UMI.
    """
    df.sparkSession.dataSource.register(BusSource)
    names = [c.lower() for c in df.columns]
    by = order or (["pos"] if "pos" in names else ["CB", "UMI", "EC"])
    out = df.repartitionByRange(*by).sortWithinPartitions(*by)
    if "pos" not in names or order:
        out = out.drop("pos") if "pos" in names else out
    out.write.format("bus").options(cb_len=str(cb_len), umi_len=str(umi_len), **options).mode("overwrite").save(path)


def convert(spark: SparkSession, source: str, target: str, layout: str = "parts", **options: str) -> None:
    """Reads one path and writes another, so compresses or decompresses it; lengths and order are kept."""
    head = header_of(source)
    write_bus(read_bus(spark, source), target, head.cb_len, head.umi_len, layout=layout, **options)


def write_head(spark: SparkSession, source: str, target: str, n: int) -> None:
    """The first ``n`` records of a path as one file."""
    head = header_of(source)
    write_bus(read_bus(spark, source, head=str(n)).orderBy("pos").limit(n), target, head.cb_len, head.umi_len, layout="file")
