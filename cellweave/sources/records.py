"""Headers and fixed-width records of the plain binary format."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# --- fixed values of the format ------------------------------------------------------------
MAGIC = {"plain": b"BUS\x00", "blocks": b"BUS\x01"}
VERSION, HEADER_BYTES, RECORD_BYTES = 1, 20, 32
TEXT = b"BUS file produced by kallisto"
RECORD = np.dtype([("CB", "<u8"), ("UMI", "<u8"), ("EC", "<u4"), ("COUNT", "<u4"), ("FLAG", "<u4"), ("pad", "<u4")])
#: Longest barcode or identifier whose number fits a signed 64-bit integer.
LONGEST = 31

FIELDS = ("CB", "UMI", "EC", "COUNT", "FLAG")
DDL = "CB bigint, UMI bigint, EC bigint, COUNT bigint, FLAG bigint, pos bigint"
WIDE_DDL = "CB decimal(20,0), UMI decimal(20,0), EC bigint, COUNT bigint, FLAG bigint, pos bigint"


@dataclass(frozen=True)
class Header:
    """What stands before the records; ``start`` is where they begin."""

    kind: str
    cb_len: int
    umi_len: int
    text: bytes = TEXT

    @property
    def start(self) -> int:
        return HEADER_BYTES + len(self.text)

    def to_bytes(self) -> bytes:
        return struct.pack("<4sIIII", MAGIC[self.kind], VERSION, self.cb_len, self.umi_len, len(self.text)) + self.text


def read_header(f) -> Header:
    """The header at the beginning of a binary file object."""
    raw = f.read(HEADER_BYTES)
    if len(raw) < HEADER_BYTES:
        raise ValueError("the file is too short for a header")
    magic, _, cb_len, umi_len, n = struct.unpack("<4sIIII", raw)
    kind = next((k for k, m in MAGIC.items() if m == magic), None)
    if kind is None:
        raise ValueError(f"not a file of this format: it begins with {magic!r}")
    return Header(kind, cb_len, umi_len, f.read(n))


def decode(raw: bytes) -> np.ndarray:
    """Records of a byte string; bytes after the last whole record are passed over."""
    return np.frombuffer(raw, RECORD, len(raw) // RECORD_BYTES)


def encode(columns: dict[str, np.ndarray]) -> bytes:
    """The bytes of records; values that do not fit their field are an error."""
    n = len(columns["CB"])
    out = np.zeros(n, RECORD)
    for name in FIELDS:
        v = columns[name]
        if name in ("EC", "COUNT", "FLAG") and n and (v.min() < 0 or v.max() > 0xFFFFFFFF):
            raise ValueError(f"{name} must be in 0..2**32-1")
        if name in ("CB", "UMI") and v.dtype.kind == "i" and n and v.min() < 0:
            raise ValueError(f"{name} must not be negative")
        out[name] = v
    return out.tobytes()


def to_batch(columns: dict[str, np.ndarray], first: int, wide: bool) -> pa.RecordBatch:
    """Columns of records as Arrow, with pos counting from ``first``."""
    arrays = []
    for name in FIELDS:
        v = columns[name]
        if name in ("CB", "UMI"):
            if wide:
                arrays.append(pa.array([int(x) for x in v], pa.decimal128(20, 0)))
                continue
            if len(v) and int(v.max()) > 0x7FFFFFFFFFFFFFFF:
                raise ValueError(f"{name} does not fit a bigint; read with wide=true")
        arrays.append(pa.array(v.astype(np.int64)))
    arrays.append(pa.array(np.arange(first, first + len(columns["CB"]), dtype=np.int64)))
    return pa.RecordBatch.from_arrays(arrays, names=[*FIELDS, "pos"])


def from_batch(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of records from Arrow, names in any case; a null is an error."""
    by_name = {n.upper(): i for i, n in enumerate(batch.schema.names)}
    out = {}
    for name in FIELDS:
        c = batch.column(by_name[name]) if name in by_name else None
        if c is None:
            if name != "FLAG":
                raise ValueError(f"column {name} is missing")
            out[name] = np.zeros(batch.num_rows, np.int64)
            continue
        if c.null_count:
            raise ValueError(f"{name} must not be null")
        out[name] = np.array([int(x) for x in c.to_pylist()], np.uint64) if pa.types.is_decimal(c.type) else c.to_numpy(zero_copy_only=False)
    return out
