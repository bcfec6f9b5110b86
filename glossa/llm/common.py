"""What the operators share: byte-level words, 64-bit hashing, slabs of rows, bit packing.

All helpers work on numpy arrays over a slab of documents, so a document's bytes are
touched by vector instructions only. Words are runs of bytes other than space and
\\x09-\\x0D, as everywhere in this subpackage.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:
    _libc = None

U64 = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: Powers that stay in a worker (16 bytes each); larger slabs make their own.
KEPT_POWERS = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n. A worker keeps those up to KEPT_POWERS."""
    found = _powers
    if len(_powers[0]) < n:
        found = []
        for b in (_BASE, _INV):
            p = np.full(n, b, U64)
            p[:1] = 1
            found.append(np.cumprod(p, out=p))
        for k in range(2 if len(_powers[0]) < KEPT_POWERS else 0):
            _powers[k] = found[k][:KEPT_POWERS].copy()
    return found[0][:n], found[1][:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after another, and where each row starts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def find_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words before each row (one more than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SEP[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[off[:-1][off[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] | ~inside[1:]
    start = np.flatnonzero(inside & first)
    return start, np.flatnonzero(inside & last) + 1, np.searchsorted(start, off)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal bytes wherever they stand."""
    if not len(start):
        return np.zeros(0, U64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words inside a row, and the row of each.

    words: hashes of the words of all rows; counts: words before each row. A row of fewer
    words than width, but some, gives its whole sequence as one shingle.
    """
    n = np.diff(counts)
    m = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), m)
    at = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + counts[:-1][row]
    short = n[row] < width
    h = np.zeros(len(row), U64)
    for k in range(width):
        ok = (at + k < counts[1:][row]) if short.any() else None
        w = words[np.minimum(at + k, len(words) - 1)] if len(words) else words
        term = mix(w + U64((k + 1) * 0xA0761D6478BD642F % (1 << 64)))
        h += term if ok is None else np.where(ok, term, U64(0))
    return mix(h + np.where(short, n[row], width).astype(U64)), row


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of each item, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def trim() -> None:
    """Give memory that numpy and Arrow no longer use back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


#: What operators leave in a worker between their tasks: a name, and how to drop it.
_resident: dict[str, Callable[[], None]] = {}


def resident(name: str, drop: Callable[[], None]) -> None:
    """Says that this worker now holds something of use to later tasks of the operator `name`."""
    _resident[name] = drop


def alone(name: str = "") -> None:
    """Drops what other operators than `name` left in this worker: workers outlive stages."""
    others = [n for n in _resident if n != name]
    for n in others:
        _resident.pop(n)()
    if others:
        trim()


def slabs(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2_000_000, name: str = "") -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about `limit` bytes of text each (at least a row). name: the operator's, if it left something in the worker."""
    alone(name)
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        size = pc.fill_null(pc.binary_length(t[text].cast(pa.large_string())), 0).to_numpy().astype(np.int64)
        group = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), t.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield t.slice(a, b - a).combine_chunks()
        trim()


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dictionaries, one at a time: rows of packed arrays may be megabytes each."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        trim()


def slices(total: np.ndarray, n: int) -> pa.RecordBatch:
    """An array in n rows (slice, s), to be summed by `summed`."""
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([x.astype(np.float64).tobytes() for x in np.array_split(total, n)], pa.binary())], ["slice", "s"])


def summed(parts: DataFrame, n: int) -> np.ndarray:
    """The sum of the arrays that tasks sent in n slices; empty if none did. A slice is summed over all
    tasks at one place, so the driver gets one array, whatever the number of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(raw.as_buffer(), np.float64)
                total[k] = total[k] + x if k in total else x.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "s"])

    rows = parts.repartition(n, "slice").mapInArrow(add, "slice int, s binary").collect()
    return np.concatenate([np.frombuffer(r["s"]) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else np.zeros(0)


def by_bytes(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """A column of texts in runs of about `limit` bytes (at least a row)."""
    alone()
    size = pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(size) - size) // limit)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield column.slice(a, b - a)


def pack(values: np.ndarray) -> bytes:
    """An array as bytes: its length and its dtype's letter first."""
    return struct.pack("<c", values.dtype.char.encode()) + np.ascontiguousarray(values).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(raw[:1].decode()), offset=1)


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code of non-negative gaps with parameter 2**k: unary quotients, then remainders."""
    n = len(values)
    q = (values >> U64(k)).astype(np.int64)
    ends = np.cumsum(q + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    low = ((values[:, None] >> np.arange(k, dtype=U64)[None, :]) & U64(1)).astype(np.uint8) if n and k else np.zeros(0, np.uint8)
    return struct.pack("<IBI", n, k, len(unary)) + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def rice_decode(raw: bytes) -> np.ndarray:
    n, k, m = struct.unpack_from("<IBI", raw)
    at = struct.calcsize("<IBI")
    unary = np.unpackbits(np.frombuffer(raw, np.uint8, (m + 7) // 8, at))[:m]
    q = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    if not n or not k:
        return q.astype(U64)
    low = np.unpackbits(np.frombuffer(raw, np.uint8, (n * k + 7) // 8, at + (m + 7) // 8))[: n * k].reshape(n, k)
    return (q.astype(U64) << U64(k)) | (low.astype(U64) << np.arange(k, dtype=U64)[None, :]).sum(1, dtype=U64)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def crc_mod(column: str, m: int):
    """crc32 of the id as text modulo m (null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def whole_text(df: DataFrame, text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))


def tasks_for(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
