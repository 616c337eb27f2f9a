"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of word shingles; equal sets are one class from the start.  Each class has a
signature of minimum hashes: bands of five give candidates, one byte of each hash is kept as a sketch.
Within a bucket of candidates the sketches are compared a batch at a time; a pair is pruned as soon as
the posterior probability that its similarity reaches the threshold falls below the chosen miss
probability.  A bucket emits a spanning forest of the surviving pairs and never all of them.  The forest's
connected components are verified on full shingle sets: a search over each component compares a
member with those not reached yet, so every link that joins different groups is confirmed exactly.

Defined results: texts without words have an empty set, are linked with nothing and form a group of
their own; a null doc_id never names a group unless all of a group's are null; the group's name is
its smallest doc_id, and of repeated rows with that doc_id each counts as kept by ``components``, while
``keep_one`` keeps the first; extra columns are dropped by ``components`` and pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bloom import BlockedBloom, filter_of
from lodestone.llm.common import RangeHash, binary_array, buffer_of, chunks, lowered, mix, plain, ranges, segments, whole_groups, word_bounds, word_hashes, written

SHINGLE = 5
SIMILARITY = 80
#: A pair at the threshold shares no band of all with probability (1 - 0.8**5)**45 < 2e-8.
BANDS, ROWS = 45, 5
#: Probability at which a pair that reaches the threshold may be pruned at each batch.
MISS = 1e-9
BATCH = 45

_KEY = 16


def shingle_sets(buf: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (one more at the end)."""
    low = lowered(buf)
    s, e, first = word_bounds(low, at)
    hashes = RangeHash(word_hashes(low, s, e))
    n_words = np.diff(first)
    counts = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    starts = ranges(first[:-1], counts)
    text = np.repeat(np.arange(len(counts)), counts)
    h = hashes.get(starts, starts + np.minimum(size, n_words)[text])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(counts) + 1))


def _set_keys(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sixteen bytes for each set."""
    out = np.empty((len(begin) - 1, 2), np.uint64)
    for k in range(2):
        out[:, k] = RangeHash(h, k).get(begin[:-1], begin[1:])
    return out.view(np.uint8).reshape(-1, _KEY)


def _half(keys: np.ndarray) -> np.ndarray:
    """The first eight bytes of each key as a number."""
    return np.ascontiguousarray(keys.reshape(-1, _KEY)[:, :8]).view(np.int64).ravel()


def _factors() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (mix(seeds) >> np.uint64(32)).astype(np.uint32)
    return x[: BANDS * ROWS] | np.uint32(1), x[BANDS * ROWS :]


def signatures(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minimum hashes of each nonempty set; a row per set."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin) - 1, BANDS * ROWS), np.uint32)
    if not len(out):
        return out
    for j, (a, b) in enumerate(zip(*_factors(), strict=True)):
        out[:, j] = np.minimum.reduceat((x ^ b) * a, begin[:-1])
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(sig), b, np.uint64)
        for r in range(ROWS):
            k = mix(k ^ sig[:, b * ROWS + r].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        keys[:, b] = k
    return keys


def _least_matches(similarity: int, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, matches below which a pair is pruned) for each batch, from a uniform prior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    log, log1 = np.log(grid), np.log1p(-grid)
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        least = 0
        for m in range(n + 1):
            density = m * log + (n - m) * log1
            density = np.exp(density - density.max())
            if density[grid >= similarity / 100].sum() / density.sum() >= miss:
                least = m
                break
        out.append((n, least))
    return out


def survivors(one: np.ndarray, others: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Rows of ``others`` that no batch prunes against ``one``."""
    left = np.arange(len(others))
    matches = np.zeros(len(others), np.int64)
    done = 0
    for n, least in limits:
        matches = matches + (others[left, done:n] == one[done:n]).sum(axis=1)
        keep = matches >= least
        left, matches, done = left[keep], matches[keep], n
    return left


def _forest(sketch: np.ndarray, size: np.ndarray, limits: list[tuple[int, int]], similarity: int) -> list[tuple[int, int]]:
    """Edges that connect whatever the surviving pairs connect."""
    group = np.arange(len(sketch))
    edges = []
    for i in range(len(sketch) - 1):
        rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if not len(rest):
            if (group == group[i]).all():
                break
            continue
        rest = rest[np.minimum(size[rest], size[i]) * 100 >= similarity * np.maximum(size[rest], size[i])]
        for j in rest[survivors(sketch[i], sketch[rest], limits)]:
            if group[j] != group[i]:
                edges.append((i, int(j)))
                group[group == group[j]] = group[i]
    return edges


def _bucket_pairs(rows: DataFrame, similarity: int, limits: list[tuple[int, int]]) -> DataFrame:
    """Candidate edges (a, b) from rows (band, key, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "band"):
            band = np.asarray(table.column("band").combine_chunks())
            key = buffer_of(table.column("key"))[0].reshape(-1, _KEY)
            sketch = buffer_of(table.column("sketch"))[0].reshape(-1, BANDS * ROWS)
            size = np.asarray(table.column("n").combine_chunks())
            start, end = segments(band)
            two = start[end - start == 2]
            fits = np.minimum(size[two], size[two + 1]) * 100 >= similarity * np.maximum(size[two], size[two + 1])
            two = two[fits]
            matches = np.zeros(len(two), np.int64)
            done = 0
            for n, least in limits:
                matches = matches + (sketch[two, done:n] == sketch[two + 1, done:n]).sum(axis=1)
                two, matches, done = two[matches >= least], matches[matches >= least], n
            a, b = [two], [two + 1]
            for i, j in zip(start[end - start > 2].tolist(), end[end - start > 2].tolist(), strict=True):
                edges = np.array(_forest(sketch[i:j], size[i:j], limits, similarity), np.int64).reshape(-1, 2) + i
                a.append(edges[:, 0])
                b.append(edges[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([binary_array(key[a].ravel(), np.full(len(a), _KEY)), binary_array(key[b].ravel(), np.full(len(b), _KEY))], ["a", "b"])

    # In order of keys, so that the smallest key of a group is its hub in every band.
    dealt = rows.repartition(F.col("band")).sortWithinPartitions("band", "key")
    return dealt.mapInArrow(run, "a binary, b binary")


def folded(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b), a < b, that connect the same: each end keeps the edge to its least neighbour, which gets those to the others.

    A stream over sorted edges: no end's neighbours are gathered.  Edges of one group from many bands
    become about one a member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, least = b"", b""
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (buffer_of(batch.column(i))[0].reshape(-1, _KEY) for i in range(2))
            new = np.ones(len(b), bool)
            new[1:] = (b[1:] != b[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            hub = a[np.repeat(first, np.diff(np.append(first, len(b))))]
            if b[0].tobytes() == end:
                # The end's least neighbour came with an earlier batch.
                size = int(first[1]) if len(first) > 1 else len(b)
                hub[:size] = np.frombuffer(least, np.uint8)
                new[0] = False
            end, least = b[-1].tobytes(), hub[-1].tobytes()
            other = np.where(new[:, None], b, a)
            again = np.zeros(len(b), bool)
            again[1:] = (a[1:] == a[:-1]).all(axis=1) & ~new[1:]
            keep = ~again & (hub != other).any(axis=1)
            x, y = hub[keep], other[keep]
            yield pa.RecordBatch.from_arrays([binary_array(x.ravel(), np.full(len(x), _KEY)), binary_array(y.ravel(), np.full(len(y), _KEY))], ["a", "b"])

    return edges.repartition(F.col("b")).sortWithinPartitions("b", "a").mapInArrow(run, "a binary, b binary")


def connected(edges: DataFrame) -> DataFrame:
    """(key, root): the smallest key reachable from each end of the edges (a, b), by minimum labels and pointer jumping."""
    both = written(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")))
    labels = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("root")))
    while True:
        seen = both.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("root").alias("near"))
        step = labels.join(seen, "v").select("v", F.least("root", "near").alias("next"), F.col("root").alias("old"))
        jump = labels.select(F.col("v").alias("next"), F.col("root").alias("far"))
        new = written(step.join(jump, "next").select("v", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("old")).alias("changed")))
        labels = new.select("v", "root")
        if not new.filter("changed").limit(1).count():
            return labels.withColumnRenamed("v", "key")


def _reach(sets: np.ndarray, begin: np.ndarray, sketch: np.ndarray, similarity: int, limits: list[tuple[int, int]]) -> np.ndarray:
    """The number of the first member that each member is linked with, directly or through others; links are exact."""
    n = len(begin) - 1
    size = np.diff(begin)
    root = np.full(n, -1)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], queue = seed, [seed]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(root < 0)
            if not len(rest):
                return root
            rest = rest[np.minimum(size[rest], size[i]) * 100 >= similarity * np.maximum(size[rest], size[i])]
            rest = rest[survivors(sketch[i], sketch[rest], limits)]
            if not len(rest):
                continue
            own = sets[begin[i] : begin[i + 1]]
            flat = sets[ranges(begin[rest], size[rest])]
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(size[rest]) - size[rest])
            linked = rest[common * 100 >= similarity * (size[i] + size[rest] - common)]
            root[linked] = seed
            queue.extend(linked.tolist())
    return root


def _verified(docs: DataFrame, members: DataFrame, sketches: DataFrame, size: int, similarity: int, limits: list[tuple[int, int]]) -> DataFrame:
    """(key, root) of exactly linked groups within the candidate components ``members`` (key, root)."""
    # A key is a hash already: its first half, as a number, is what the filter holds.
    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_half(buffer_of(b.column(0))[0]))], ["half"])

    shared = filter_of(written(members.select("key").mapInArrow(halves, "half bigint")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = BlockedBloom(shared.value)
        for _, buf, at in chunks(batches, "text"):
            h, begin = shingle_sets(buf, at, size)
            keys = _set_keys(h, begin)
            counts = np.diff(begin)
            keep = np.flatnonzero(known.might_hold(_half(keys.ravel())))
            yield pa.RecordBatch.from_arrays([binary_array(keys[keep].ravel(), np.full(len(keep), _KEY)), binary_array(h[ranges(begin[keep], counts[keep])].view(np.uint8), counts[keep] * 8)], ["key", "shingles"])

    found = docs.select("text").mapInArrow(sets, "key binary, shingles binary")
    rows = found.groupBy("key").agg(F.first("shingles").alias("shingles")).join(members, "key").join(sketches, "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "root", 2000):
            key = buffer_of(table.column("key"))[0].reshape(-1, _KEY)
            raw, at = buffer_of(table.column("shingles"))
            h, begin = np.frombuffer(raw.tobytes(), np.uint64), at // 8
            sketch = buffer_of(table.column("sketch"))[0].reshape(-1, BANDS * ROWS)
            group = buffer_of(table.column("root"))[0].reshape(-1, _KEY)
            comp = np.concatenate(([0], np.cumsum((group[1:] != group[:-1]).any(axis=1))))
            root = np.empty(len(key), np.int64)
            for i, j in zip(*segments(comp), strict=True):
                b = begin[i : j + 1]
                root[i:j] = i + _reach(h[b[0] : b[-1]], b - b[0], sketch[i:j], similarity, limits)
            yield pa.RecordBatch.from_arrays([binary_array(key.ravel(), np.full(len(key), _KEY)), binary_array(key[root].ravel(), np.full(len(key), _KEY))], ["key", "root"])

    dealt = rows.select("root", "key", "shingles", "sketch").repartition(F.col("root")).sortWithinPartitions("root", "key")
    return dealt.mapInArrow(search, "key binary, root binary")


def components(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    docs = plain(docs, "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    limits = _least_matches(similarity, MISS)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in chunks(batches, "text"):
            h, begin = shingle_sets(buf, at, shingle)
            counts = np.diff(begin)
            some = np.flatnonzero(counts)
            sig = signatures(h, np.append(begin[some], len(h)))
            bands, sketch = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            bands[some], sketch[some] = BANDS * 8, BANDS * ROWS
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), binary_array(_set_keys(h, begin).ravel(), np.full(len(counts), _KEY)), binary_array(_band_keys(sig).view(np.uint8).ravel(), bands), binary_array((sig >> np.uint32(24)).astype(np.uint8).ravel(), sketch)],
                ["doc_id", "n", "key", "bands", "sketch"],
            )

    signed = written(docs.mapInArrow(sign, f"doc_id {id_type}, n bigint, key binary, bands binary, sketch binary"))
    classes = signed.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes)

    def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(buffer_of(b.column(0))[0].tobytes(), np.int64))], ["band"])

    often = written(classes.select("bands").mapInArrow(band_keys, "band bigint").groupBy("band").count().filter("count > 1").select("band"))
    shared = filter_of(often)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = BlockedBloom(shared.value)
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.frombuffer(buffer_of(b.column(3))[0].tobytes(), np.int64)
            hit = np.flatnonzero(known.might_hold(keys))
            row = pa.array(hit // BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), *(b.column(i).take(row) for i in range(3))], ["band", "key", "n", "sketch"])

    rows = classes.select("key", "n", "sketch", "bands").mapInArrow(candidates, "band bigint, key binary, n bigint, sketch binary")
    edges = written(folded(folded(_bucket_pairs(rows, similarity, limits))).distinct())
    roots = written(_verified(docs, connected(edges), classes.select("key", "sketch"), shingle, similarity, limits))
    least = classes.select("key", "least").join(roots, "key").groupBy("root").agg(F.min("least").alias("component"))
    named = classes.select("key", "least").join(roots.join(least, "root").select("key", "component"), "key", "left")
    named = named.select("key", F.coalesce("component", "least").alias("component"))
    out = signed.select("doc_id", "n", "key").join(named, "key", "left")
    group = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest doc_id, of repeated ones the first; rows without a doc_id stay."""
    rows = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")))
    named = rows.filter(F.col("doc.doc_id").isNotNull()).select(F.struct(F.col("doc.doc_id").alias("doc_id"), "row").alias("doc_id"), F.col("doc.text").alias("text"))
    gone = components(named, shingle, similarity).filter("not kept").select("doc_id.row")
    return rows.join(gone, "row", "left_anti").select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
