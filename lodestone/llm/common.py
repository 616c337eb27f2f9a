"""Shared pieces of the corpus operators: byte-level tokenising, hashing and scratch space.

Everything here works on whole texts.  Python code sees Arrow batches and handles them as flat byte
buffers with numpy; no function loops over characters.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scratch import discard, written  # noqa: F401

#: Bytes of text that are handled at once; one longer text is handled alone.
CHUNK_BYTES = 2 << 20

#: The six ASCII white-space characters that separate words.
WHITE = " \t\n\x0b\x0c\r"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)


def release_memory() -> None:
    """Gives freed memory back to the system: a worker that idles between tasks would hold it else."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a whole text; null and empty texts share a key."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())

        def table(b: int) -> np.ndarray:
            out = np.ones(size, np.uint64)
            done, step = 1, b
            while done < size:
                m = min(done, size - done)
                out[done : done + m] = out[:m] * np.uint64(step)
                done, step = done + m, step * step % (1 << 64)
            return out

        have = _POWERS[base] = (table(base), table(pow(base, -1, 1 << 64)))
    return have


class RangeHash:
    """Hashes of arbitrary ranges of a sequence of unsigned integers in constant time each."""

    def __init__(self, values: np.ndarray, seed: int = 0):
        self.base = _BASES[seed]
        n = len(values)
        up, _ = _powers(self.base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def get(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _powers(self.base, len(self.sums))
        out = (self.sums[end] - self.sums[start]) * down[start]
        return mix(out + (end - start).astype(np.uint64) * _ODD)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes in ``column``, with that column's bytes and offsets."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        whole, at = buffer_of(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row), whole[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[buf]


def word_bounds(buf: np.ndarray, at: np.ndarray, other: np.ndarray = _IS_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each text (one more at the end).

    ``other`` says which byte values separate words; words never cross the bounds of a text.
    """
    inside = ~other[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = at[1:-1]
    cuts = cuts[cuts < len(buf)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = at[1:-1]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at, "left")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return RangeHash(buf.astype(np.uint64) + np.uint64(1), seed).get(starts, ends)


def binary_array(pieces: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column cut from ``pieces`` (a contiguous array) by byte lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(pieces))])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] numbers), then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = counts > 0
    s, c = starts[full].astype(np.int64), counts[full].astype(np.int64)
    first = np.cumsum(c) - c
    out[first[0]] = s[0]
    out[first[1:]] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)


def covered_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as maximal disjoint runs; touching intervals are one run."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    if not len(s):
        return s, e
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def segments(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return first, np.append(first[1:], n)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; a group never spans two tables."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        column = table.column(key).combine_chunks()
        last = column[len(column) - 1]
        same = np.asarray(pa.compute.equal(column, last))
        cut = len(column) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names cannot matter."""
    return df.select(*(F.col(f"`{c}`") for c in columns))
