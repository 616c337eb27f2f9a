"""Benchmark decontamination by winnowing.

Of each sliding window of ten words, the smallest hash of its five-word shingles is kept as a
fingerprint.  Equal windows keep equal fingerprints, so joining the fingerprints of corpus and benchmark
finds every shared window; each hit is extended to the windows around it and confirmed on the whole
window.  Items shorter than a window have a single window, the whole item, looked up by its own length.

The benchmark's fingerprints are broadcast in blocks of a checked size: one block is one pass over the
corpus, and a benchmark of any size is a number of such passes whose hits are united per document.

Defined results: null and empty texts have no words; an item without words has no window and never
counts; a null item id counts as the empty string; repeated items each count; repeated documents are
judged one by one; extra columns pass through ``drop_contaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import RangeHash, buffer_of, chunks, covered_runs, lowered, plain, ranges, word_bounds, word_hashes, written

WINDOW = 10
SHINGLE = 5
#: Bytes of benchmark text whose fingerprints are broadcast at once.
BLOCK_BYTES = 8 << 20

_OTHER = np.ones(256, bool)
_OTHER[48:58] = _OTHER[65:91] = _OTHER[97:123] = False
_OTHER[128:] = False


def _words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word and the number of each text's first word."""
    low = lowered(buf)
    s, e, first = word_bounds(low, at, _OTHER)
    h = word_hashes(low, s, e)
    return h, h ^ np.uint64(0xA5A5A5A5A5A5A5A5), first


def _starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every start of ``n`` words of one text, and the number of that text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    return ranges(first[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def _fingerprints(hashes: RangeHash, starts: np.ndarray) -> np.ndarray:
    """Position of the fingerprint of each window; the leftmost of equal ones."""
    n = len(hashes.sums) - SHINGLE
    if n <= 0 or not len(starts):
        return np.zeros(0, np.int64)
    at = np.arange(n)
    code = (hashes.get(at, at + SHINGLE) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = WINDOW - SHINGLE + 1
    least = code[: n - width + 1].copy()
    for k in range(1, width):
        np.minimum(least, code[k : n - width + 1 + k], out=least)
    return (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Index:
    """Fingerprints and distinct windows of one block of the benchmark; windows name the set of items that hold them."""

    def __init__(self, texts: pa.Array, ids: list[str]):
        self.ids = pa.array(ids, pa.string())
        h, h2, first = _words(*buffer_of(texts))
        a, b = RangeHash(h), RangeHash(h2, 1)
        sizes = np.diff(first)
        starts, item = _starts(first, WINDOW)
        self.prints = np.unique(a.get(p := _fingerprints(a, starts), p + SHINGLE)) if len(starts) else np.zeros(0, np.uint64)
        found = {WINDOW: self._windows(WINDOW, a, b, starts, item)} if len(starts) else {}
        for n in range(1, WINDOW):
            some = np.flatnonzero(sizes == n)
            if len(some):
                found[n] = self._windows(n, a, b, first[some], some)
        # Windows of a passage are mostly held by the same items: each distinct set of items is kept once.
        parts = list(found.values())
        codes = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint64)
        _, kept, number = np.unique(codes, return_index=True, return_inverse=True)
        items, heads, sizes = ([np.zeros(0, np.int64)] for _ in range(3))
        for _, _, _, own, head in parts:
            heads.append(head + sum(map(len, items)))
            sizes.append(np.diff(np.append(head, len(own))))
            items.append(own)
        self.set_sizes = np.concatenate(sizes)[kept]
        self.set_items = np.concatenate(items)[ranges(np.concatenate(heads)[kept], self.set_sizes)]
        self.set_first = np.cumsum(self.set_sizes) - self.set_sizes
        ends = np.cumsum([len(p[0]) for p in parts])
        self.by_length = {n: (p[0], p[1], number[e - len(p[0]) : e]) for (n, p), e in zip(found.items(), ends, strict=True)}

    @staticmethod
    def _windows(n: int, a: RangeHash, b: RangeHash, starts: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        """The two hashes of each distinct window, a hash of the set of its items; the items of all, and where each window's begin."""
        x, y = a.get(starts, starts + n), b.get(starts, starts + n)
        order = np.lexsort((item, y, x))
        x, y, item = x[order], y[order], item[order].astype(np.int64)
        other = np.ones(len(x), bool)
        other[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        once = other.copy()
        once[1:] |= item[1:] != item[:-1]
        x, y, item, other = x[once], y[once], item[once], other[once]
        head = np.flatnonzero(other)
        tail = np.append(head[1:], len(x))
        return x[head], y[head], RangeHash(item.astype(np.uint64) + np.uint64(1)).get(head, tail), item, head

    def hits(self, a: RangeHash, b: RangeHash, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and set of items of each occurrence of a window."""
        found = []
        for n, (x, y, number) in self.by_length.items():
            starts, _ = _starts(first, n)
            if n == WINDOW and len(starts):
                kept = np.unique(_fingerprints(a, starts))
                v = a.get(kept, kept + SHINGLE)
                i = np.searchsorted(self.prints, v)
                kept = kept[(i < len(self.prints)) & (self.prints[np.minimum(i, len(self.prints) - 1)] == v)]
                near = np.unique((kept[:, None] - np.arange(WINDOW - SHINGLE + 1)[None, :]).ravel())
                starts = np.intersect1d(near, starts, assume_unique=True)
            if not len(starts):
                continue
            v, w = a.get(starts, starts + n), b.get(starts, starts + n)
            low, high = np.searchsorted(x, v, "left"), np.searchsorted(x, v, "right")
            rows = ranges(low, high - low)
            s = np.repeat(np.arange(len(starts)), high - low)
            same = y[rows] == w[s]
            found.append((starts[s[same]], np.full(int(same.sum()), n), number[rows[same]]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        s, n, number = (np.concatenate(x) for x in zip(*found, strict=True))
        return s, s + n, number

    def lists(self, first: np.ndarray, s: np.ndarray, e: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, int, pa.Array, pa.Array, pa.Array]]:
        """For slices from one text to another: covered word intervals (starts, ends) and item ids, a list a text."""
        n = len(first) - 1
        doc = np.searchsorted(first, s, "right") - 1
        # A gap between texts, so that runs never join two of them.
        x, y = covered_runs(s + doc, e + doc)
        run_doc = np.searchsorted(first + np.arange(n + 1), x, "right") - 1
        x, y = x - run_doc - first[run_doc], y - run_doc - first[run_doc]
        pair = np.unique(doc * np.int64(len(self.set_sizes) + 1) + number)
        pair_doc, pair_set = pair // (len(self.set_sizes) + 1), pair % (len(self.set_sizes) + 1)
        grown = np.concatenate(([0], np.cumsum(np.bincount(pair_doc, self.set_sizes[pair_set], n)))).astype(np.int64)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(grown, grown[lo] + _EXPANDED, "right")) - 1)
            p, q = np.searchsorted(pair_doc, [lo, hi])
            sets = pair_set[p:q]
            item = self.set_items[ranges(self.set_first[sets], self.set_sizes[sets])]
            both = np.unique(np.repeat(pair_doc[p:q], self.set_sizes[sets]) * np.int64(len(self.ids) + 1) + item)
            i, j = np.searchsorted(run_doc, [lo, hi])
            offsets = lambda d: pa.array(np.concatenate(([0], np.cumsum(np.bincount(d - lo, minlength=hi - lo)))).astype(np.int32))
            runs = offsets(run_doc[i:j])
            yield lo, hi, pa.ListArray.from_arrays(runs, pa.array(x[i:j])), pa.ListArray.from_arrays(runs, pa.array(y[i:j])), pa.ListArray.from_arrays(offsets(both // (len(self.ids) + 1)), self.ids.take(pa.array(both % (len(self.ids) + 1))))
            lo = hi


#: Items listed in one batch at most, but for those of a single document.
_EXPANDED = 200_000
_HITS = "starts array<bigint>, ends array<bigint>, items array<string>"


def _pass(docs: DataFrame, keys: list[str], block: pa.Table) -> DataFrame:
    """``keys``, the number of words, and the hits of one block of the benchmark for each document."""
    ids = ["" if x is None else str(x) for x in block.column("item_id").to_pylist()]
    shared = docs.sparkSession.sparkContext.broadcast(Index(block.column("text").combine_chunks(), ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch, buf, at in chunks(batches, "text"):
            h, h2, first = _words(buf, at)
            sizes = pa.array(np.diff(first))
            for lo, hi, *found in index.lists(first, *index.hits(RangeHash(h), RangeHash(h2, 1), first)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), sizes.slice(lo, hi - lo), *found], [*keys, "n_words", "starts", "ends", "items"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, n_words bigint, {_HITS}")


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words and the hits of each document: word intervals (starts, ends) and item ids, each item once a row of it."""
    docs, bench = plain(docs, "doc_id", "text"), plain(benchmark, "item_id", "text")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= block_bytes:
        return _pass(docs, ["doc_id"], bench.toArrow())
    n = -(-size * 2 // block_bytes)
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()))
    # Dealt by row, so that copies of one item spread over the blocks too.
    bench = written(bench.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))))
    passes = [_pass(rows, ["row", "doc_id"], bench.filter(F.col("part") == i).select("item_id", "text").toArrow()) for i in range(n)]
    every = passes[0]
    for x in passes[1:]:
        every = every.union(x.filter(F.size("items") > 0))
    return every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items"))).drop("row")


def digest(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, words hit, items found and their hash, and whether any word is hit."""

    # Words in the union of the intervals: each adds what lies beyond the end of those before it.
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    grow = lambda acc, x: F.struct(F.greatest(acc["end"], x["ends"]).alias("end"), (acc["total"] + F.greatest(F.lit(0).cast("long"), x["ends"] - F.greatest(acc["end"], x["starts"]))).alias("total"))
    covered = F.aggregate(F.array_sort(F.arrays_zip("starts", "ends")), zero, grow, lambda acc: acc["total"])
    none = hashlib.sha256(b"").hexdigest()
    found = find(docs, benchmark, block_bytes)
    items = F.when(F.size("items") > 0, F.sha2(F.array_join(F.array_sort("items"), ","), 256)).otherwise(none)
    return found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns."""
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc_id"), F.col("text"))
    return find(packed, benchmark).filter(F.size("items") == 0).select(*(F.col(f"doc_id.`{c}`").alias(c) for c in names))
