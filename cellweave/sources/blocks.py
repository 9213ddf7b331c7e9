"""The block-compressed format: sections of one column each, packed bit by bit.

Bits are filled from the highest of each word; words are little-endian, of 64 bits, for EC of 32.
CB, UMI, COUNT and FLAG are run-length coded and written in Fibonacci code. EC is written in
blocks of 512 numbers with a common bit width and patched exceptions: Fibonacci codes of the width,
the least number, the number of exceptions and the gaps between their places, all plus 1, and of
their high bits, filled up to 32 bits, then the low bits of all 512. No file of another program was
at hand to check this layout; it is only known to read what this module writes.
"""

from __future__ import annotations

import struct

import numpy as np

# --- fixed values of the format ------------------------------------------------------------
PFD_BLOCK = 512
SUB_HEADER, SUB_HEADER_BYTES = "<III", 12  # records a block, numbers a patched block, lossy identifiers
MAX_RECORDS, MAX_BYTES, COUNT_BITS = (1 << 30) - 1, (1 << 34) - 1, 30

_FIB = [1, 2]
while _FIB[-1] + _FIB[-2] < 1 << 64:
    _FIB.append(_FIB[-1] + _FIB[-2])
FIB = np.array(_FIB, np.uint64)


def pack_header(n_bytes: int, n_records: int) -> bytes:
    """The eight bytes before a block."""
    if n_records >= MAX_RECORDS or n_bytes >= MAX_BYTES:
        raise ValueError("the block is too large")
    return struct.pack("<Q", (n_bytes << COUNT_BITS) | n_records)


def unpack_header(raw: bytes) -> tuple[int, int]:
    """(bytes, records) of a block; (0, 0) marks the end of the file."""
    (x,) = struct.unpack("<Q", raw)
    return x >> COUNT_BITS, x & ((1 << COUNT_BITS) - 1)


# --- Fibonacci code ------------------------------------------------------------------------


def fib_encode(values: np.ndarray) -> np.ndarray:
    """Bits of the Fibonacci codes of positive numbers: the Zeckendorf sum, smallest term first, and a 1."""
    v = values.astype(np.uint64)
    if len(v) and v.min() < 1:
        raise ValueError("0 has no Fibonacci code")
    if not len(v):
        return np.zeros(0, np.uint8)
    top = int(np.searchsorted(FIB, v.max(), "right"))
    bits = np.zeros((len(v), top + 1), np.uint8)
    rest, high = v.copy(), np.zeros(len(v), np.int64)
    for i in range(top - 1, -1, -1):
        hit = rest >= FIB[i]
        rest[hit] -= FIB[i]
        bits[hit, i] = 1
        high = np.where(hit & (high == 0), i + 1, high)
    bits[np.arange(len(v)), high] = 1
    return bits[np.arange(top + 1)[None, :] <= high[:, None]]


def fib_decode(bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, ends): at most ``most`` codes from the beginning of ``bits`` and the bit after each."""
    pair = np.flatnonzero(bits[:-1] & bits[1:]) if len(bits) > 1 else np.zeros(0, np.int64)
    if not len(pair):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # in a row of overlapping pairs every second one ends a code
    new = np.r_[True, np.diff(pair) > 1]
    run_start = np.maximum.accumulate(np.where(new, np.arange(len(pair)), 0))
    pair = pair[(np.arange(len(pair)) - run_start) % 2 == 0][:most]
    ends = pair + 2
    starts = np.r_[0, ends[:-1]]
    ones = np.flatnonzero(bits[: ends[-1]])
    code = np.searchsorted(ends, ones, "right")
    place = ones - starts[code]
    keep = ones != ends[code] - 1  # not the closing 1
    place, code = place[keep], code[keep]
    out = np.zeros(len(ends), np.uint64)
    np.add.at(out, code, FIB[np.minimum(place, len(FIB) - 1)])
    return out, ends


# --- words ---------------------------------------------------------------------------------


def to_words(bits: np.ndarray, word: int) -> bytes:
    """Bits padded with zeros to whole words of ``word`` bytes, each little-endian."""
    raw = np.packbits(np.r_[bits, np.zeros(-len(bits) % (8 * word), np.uint8)])
    return raw.reshape(-1, word)[:, ::-1].tobytes()


def from_words(raw: bytes, word: int) -> np.ndarray:
    """Bits of the whole words of a byte string."""
    raw = raw[: len(raw) // word * word]
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, word)[:, ::-1].reshape(-1))


# --- runs ----------------------------------------------------------------------------------


def run_encode(values: np.ndarray, special: int, shift: bool) -> np.ndarray:
    """Runs of ``special`` become (marker, length), other values stay; with ``shift`` all but lengths are raised by 1."""
    v = values.astype(np.uint64)
    add = np.uint64(1 if shift else 0)
    if not len(v):
        return v
    is_special = v == special
    first = np.flatnonzero(np.r_[True, ~(is_special[1:] & is_special[:-1])])
    length = np.diff(np.r_[first, len(v)]).astype(np.uint64)
    head = is_special[first]
    out = np.zeros(len(first) + int(head.sum()), np.uint64)
    at = np.arange(len(first)) + np.r_[0, np.cumsum(head)[:-1]]
    out[at] = v[first] + add
    out[at[head] + 1] = length[head]
    return out


def run_decode(codes: np.ndarray, special: int, shift: bool, n: int) -> tuple[np.ndarray, int]:
    """(values, codes used): the first ``n`` values of run_encode()'s result."""
    add = 1 if shift else 0
    marker = codes == special + add
    at = np.flatnonzero(marker)
    if len(at):  # a length may look like a marker: of a row of markers every second one is a length
        new = np.r_[True, np.diff(at) > 1]
        run_start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
    at = at[at + 1 < len(codes)]
    is_length = np.zeros(len(codes), bool)
    is_length[at + 1] = True
    heads = np.flatnonzero(~is_length)
    times = np.ones(len(heads), np.int64)
    lengths = np.zeros(len(codes), np.int64)
    lengths[at] = np.minimum(codes[at + 1], np.uint64(n + 1)).astype(np.int64)
    hit = np.isin(heads, at)
    times[hit] = lengths[heads[hit]]
    upto = np.cumsum(times)
    k = int(np.searchsorted(upto, n))
    if n and (k >= len(upto) or upto[k] != n):
        raise ValueError("a section does not hold the records it should")
    heads, times = heads[: k + 1], times[: k + 1]
    values = np.repeat(codes[heads] - np.uint64(add), times)[:n] if n else np.zeros(0, np.uint64)
    used = int(heads[-1]) + 1 + int(hit[k]) if n else 0
    return values, used


# --- patched numbers -----------------------------------------------------------------------


def _to_bits(v: np.ndarray, width: int) -> np.ndarray:
    """Bits of numbers, highest first, ``width`` each."""
    if not width:
        return np.zeros(0, np.uint8)
    return ((v[:, None] >> np.arange(width - 1, -1, -1).astype(np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)


def pfd_encode(values: np.ndarray) -> bytes:
    """Numbers below 2**32 in blocks: width, least, exceptions (gaps and high bits), then the low bits of all."""
    v, out = values.astype(np.uint64), []
    for i in range(0, len(v), PFD_BLOCK):
        block = v[i : i + PFD_BLOCK]
        least = block.min()
        rest = block - least
        width = int(np.sort(rest)[int(0.9 * (len(rest) - 1))]).bit_length()  # nine of ten fit
        high = rest >> np.uint64(width)
        odd = np.flatnonzero(high)
        gaps = np.diff(np.r_[0, odd]).astype(np.uint64) + np.uint64(1)
        head = np.r_[np.array([width + 1, int(least) + 1, len(odd) + 1], np.uint64), gaps, high[odd]]
        out.append(to_words(fib_encode(head), 4))
        low = np.zeros(PFD_BLOCK, np.uint64)
        low[: len(rest)] = rest & np.uint64((1 << width) - 1)
        out.append(to_words(_to_bits(low, width), 4))
    return b"".join(out)


def pfd_decode(raw: bytes, n: int) -> tuple[np.ndarray, int]:
    """(numbers, bytes used) of pfd_encode()'s result."""
    out, at = np.zeros(n, np.uint64), 0
    for i in range(0, n, PFD_BLOCK):
        size = min(PFD_BLOCK, n - i)
        # three numbers, and two of at most 128 bits for each exception
        head_bits = from_words(raw[at : at + 16 * (2 * PFD_BLOCK + 3)], 4)
        head, ends = fib_decode(head_bits, 3 + 2 * PFD_BLOCK)
        width, least, n_odd = (int(x) - 1 for x in head[:3])
        used = 2 * n_odd + 3
        gaps, high = head[3 : 3 + n_odd], head[3 + n_odd : used]
        at += -(-int(ends[used - 1]) // 32) * 4
        low = np.zeros(size, np.uint64)
        if width:
            n_bytes = PFD_BLOCK * width // 8
            bits = from_words(raw[at : at + n_bytes], 4).reshape(PFD_BLOCK, width)[:size]
            low = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(width - 1, -1, -1).astype(np.uint64))
            at += n_bytes
        if n_odd:
            odd = np.cumsum(gaps.astype(np.int64) - 1)
            low[odd] += high << np.uint64(width)
        out[i : i + size] = low + np.uint64(least)
    return out, at


# --- blocks --------------------------------------------------------------------------------


def _cell_starts(cb: np.ndarray) -> np.ndarray:
    return np.r_[True, cb[1:] != cb[:-1]] if len(cb) else np.zeros(0, bool)


def section_values(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What is written of CB, UMI, COUNT and FLAG: differences, then runs. Raises if records cannot be written."""
    cb, umi = columns["CB"].astype(np.uint64), columns["UMI"].astype(np.uint64)
    if len(cb) and (cb[1:] < cb[:-1]).any():
        raise ValueError("records must be in order of CB")
    start = _cell_starts(cb)
    prior = np.r_[np.uint64(0), umi[:-1]] if len(umi) else umi
    if (~start & (umi < prior)).any():
        raise ValueError("records of a CB must be in order of UMI")
    count = columns["COUNT"].astype(np.uint64)
    if len(count) and count.min() < 1:
        raise ValueError("a COUNT of 0 cannot be written")
    d_cb = np.r_[cb[:1], cb[1:] - cb[:-1]]
    d_umi = np.where(start, umi + np.uint64(1), umi - prior)
    return {"CB": run_encode(d_cb, 0, True), "UMI": run_encode(d_umi, 0, True), "COUNT": run_encode(count, 1, False), "FLAG": run_encode(columns["FLAG"].astype(np.uint64), 0, True)}


def encode_block(columns: dict[str, np.ndarray]) -> bytes:
    """A block with its header."""
    for name in ("EC", "COUNT", "FLAG"):
        v = columns[name]
        if len(v) and (v.min() < 0 or v.max() > 0xFFFFFFFF):
            raise ValueError(f"{name} must be in 0..2**32-1")
    s = section_values(columns)
    body = to_words(fib_encode(s["CB"]), 8) + to_words(fib_encode(s["UMI"]), 8) + pfd_encode(columns["EC"]) + to_words(fib_encode(s["COUNT"]), 8) + to_words(fib_encode(s["FLAG"]), 8)
    return pack_header(len(body), len(columns["CB"])) + body


def _section(raw: bytes, special: int, shift: bool, n: int) -> tuple[np.ndarray, int]:
    codes, ends = fib_decode(from_words(raw, 8), 2 * n)
    values, used = run_decode(codes, special, shift, n)
    bits = int(ends[used - 1]) if used else 0
    return values, -(-bits // 64) * 8


def decode_block(body: bytes, n: int) -> dict[str, np.ndarray]:
    """The columns of a block of ``n`` records."""
    d_cb, at = _section(body, 0, True, n)
    d_umi, k = _section(body[at:], 0, True, n)
    at += k
    ec, k = pfd_decode(body[at:], n)
    at += k
    count, k = _section(body[at:], 1, False, n)
    at += k
    flag, k = _section(body[at:], 0, True, n)
    at += k
    if at != len(body):
        raise ValueError("a block is longer than its records")
    cb = np.cumsum(d_cb, dtype=np.uint64)
    start = _cell_starts(cb)
    run = np.cumsum(d_umi, dtype=np.uint64)
    base = (run - d_umi)[start] if n else run
    umi = run - base[np.cumsum(start) - 1] - np.uint64(1) if n else run
    for name, v in (("EC", ec), ("COUNT", count), ("FLAG", flag)):
        if n and v.max() > 0xFFFFFFFF:
            raise ValueError(f"{name} must be in 0..2**32-1")
    return {"CB": cb, "UMI": umi, "EC": ec, "COUNT": count, "FLAG": flag}
