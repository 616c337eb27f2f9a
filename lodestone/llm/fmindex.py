"""Removal of repeated 35-word passages with a compressed FM-index per shard.

Words are symbols.  The hulls of mixed cores (see ``repeats``) are dealt to shards by their core, so all
passages that could be equal meet in one shard.  A shard is indexed once: suffix array by prefix
doubling, Burrows-Wheeler transform, and a wavelet matrix of packed bits with rank counts.  The hulls
are then streamed against it: all their positions search backward at once, a word a step, and drop out as
soon as their match occurs only once, which gives the matching statistics cut at the window's length.
Intervals of windows that match elsewhere over the full length are reported.

Defined results: null and empty texts have no words and lose none; a text without removed words still
has its words joined by one space; equal rows repeat each other's windows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import repeats
from lodestone.llm.common import binary_array, buffer_of, ranges, whole_groups, word_bounds, word_hashes

LENGTH = 35


def _tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, e, first = word_bounds(buf, at)
    return word_hashes(buf, s, e), s, e, first


def spec(length: int = LENGTH) -> repeats.Spec:
    reach = max(1, length * 16 // 35)
    return repeats.Spec(_tokens, length, reach, min(2, length - reach + 1))


class Bits:
    """A bit vector packed in words, with counts for constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(n, np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[int, Bits, int]] = []
        cur = symbols
        for level in reversed(range(max(1, int(top).bit_length()))):
            bit = (cur >> level & 1).astype(np.uint8)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))

    def ranks(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of ``symbol`` before each of the ends."""
        start, out = np.zeros(len(symbol), np.int64), list(ends)
        for level, bits, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            for k, x in enumerate((start, *out)):
                r = bits.rank(x)
                r = np.where(one, zeros + r, x - r)
                if k:
                    out[k - 1] = r
                else:
                    start = r
        return [x - start for x in out]


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least, by prefix doubling."""
    n = len(symbols)
    rank, done = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = np.zeros(n, np.int64)
        key[: n - done] = rank[done:] + 1
        key += rank * (int(rank.max(initial=0)) + 2)
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], (k[1:] != k[:-1]).astype(np.int64))))
        rank, done = new, done * 2
        if done >= depth or rank.max(initial=0) == n - 1:
            return order


class FMIndex:
    """Backward search over sequences separated by the symbol 0; real symbols are 1 and up."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.n = len(symbols)
        top = int(symbols.max(initial=0))
        order = suffix_array(symbols, depth)
        self.wavelet = WaveletMatrix(symbols[order - 1], top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.wavelet.ranks(symbol, low, high)
        return self.first[symbol] + a, self.first[symbol] + b

    def occurring(self, text: np.ndarray, starts: np.ndarray, length: int, least: int = 2) -> np.ndarray:
        """Those of the passages text[start : start + length] that occur at least ``least`` times."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n)
        for k in range(length - 1, -1, -1):
            low, high = self.extend(text[starts + k], low, high)
            keep = high - low >= least
            starts, low, high = starts[keep], low[keep], high[keep]
        return starts


_HULLS = "bucket int, words binary, n int, copies int, lo int, key binary"


def resolve(keyed: DataFrame, mixed: DataFrame, spec: repeats.Spec) -> DataFrame:
    """Repeated windows (key, start, n) of the hulls of mixed cores that have one copy."""
    parts = 4 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(values, s, e, buf, asked, run) -> Iterator[pa.RecordBatch]:
        size = asked["n"] - 1 + spec.length
        flat = values[ranges(asked["start"], size)]
        i32 = lambda a: pa.array(np.asarray(a).astype(np.int32))
        yield pa.RecordBatch.from_arrays([i32(asked["core"] % parts), binary_array(flat.view(np.uint8), size * 8), i32(asked["n"]), i32(np.minimum(asked["copies"], 2)), i32(asked["lo"]), binary_array(asked["key"].ravel(), np.full(len(size), 16))], [x.split()[0] for x in _HULLS.split(", ")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            raw, at = buffer_of(table.column("words"))
            n, copies, lo = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("n", "copies", "lo"))
            keys = buffer_of(table.column("key"))[0].reshape(-1, 16)
            sizes = np.diff(at) // 8
            # Each hull ends with a separator; its words become the numbers 1 and up.
            begin = np.cumsum(sizes + 1) - (sizes + 1)
            symbols = np.zeros(int((sizes + 1).sum()), np.int64)
            words = np.frombuffer(raw.tobytes(), np.uint64)
            symbols[ranges(begin, sizes)] = np.unique(words, return_inverse=True)[1] + 1
            index = FMIndex(symbols, spec.length + 1)
            # A passage of a hull that has several copies is known to be repeated; it is indexed but not searched.
            open_hulls = np.flatnonzero(copies == 1)
            found = index.occurring(symbols, ranges(begin[open_hulls], n[open_hulls]), spec.length)
            if not len(found):
                continue
            hull = np.searchsorted(begin, found, "right") - 1
            new = np.ones(len(found), bool)
            new[1:] = (hull[1:] != hull[:-1]) | (found[1:] != found[:-1] + 1)
            head = np.flatnonzero(new)
            place = lo[hull[head]] + found[head] - begin[hull[head]]
            yield pa.RecordBatch.from_arrays([binary_array(keys[hull[head]].ravel(), np.full(len(head), 16)), pa.array(place.astype(np.int32)), pa.array(np.diff(np.append(head, len(found))).astype(np.int32))], ["key", "start", "n"])

    shards = repeats.hulls(keyed, mixed, spec, cut, _HULLS)
    return shards.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(search, "key binary, start int, n int")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document."""
    return repeats.remove(docs, spec(length), resolve, b" ").withColumnRenamed("n_tokens", "n_words").drop("n_spans")
