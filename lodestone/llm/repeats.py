"""Exact search for strings of a fixed length that occur more than once, shared by both substring operators.

A window is ``length`` tokens of one text.  Its anchor is the position of the smallest shingle hash
among its first ``reach`` positions, so equal windows have equal anchors at equal places.  The windows
of one anchor lie next to each other and form a block.  Each holds the core, the ``length - reach + 1``
tokens from the anchor on; all lie in the hull.

* A core that occurs once proves that no window of its block is repeated.
* If all hulls around a core are equal, all their windows are repeated.
* What is left (mixed cores) goes, once per distinct hull, to a resolver that compares the tokens.

Only 64-bit hashes of cores and hulls are counted over the whole corpus, in sums that Spark combines on
the map side, so a string in a third of all texts is a few rows per task.  Texts move only where a
resolver or the final cut needs them, behind a Bloom filter of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bloom import BlockedBloom, filter_of
from lodestone.llm.common import RangeHash, binary_array, buffer_of, chunks, covered_runs, discard, mix, plain, ranges, text_key, written

Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Spec:
    """What a token is, how many make a window, and how anchors are chosen."""

    #: From bytes and text offsets: a hash of each token, its start and end byte, the first token of each text.
    tokens: Tokens
    length: int
    reach: int
    shingle: int

    @property
    def core(self) -> int:
        return self.length - self.reach + 1


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done, out = 1, v
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def blocks(values: np.ndarray, first: np.ndarray, spec: Spec) -> dict[str, np.ndarray]:
    """The blocks of all texts: text, lo (first window), n (windows), anchor, core and hull hash."""
    counts = np.maximum(np.diff(first) - spec.length + 1, 0)
    starts = ranges(first[:-1], counts)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return {k: none for k in ("text", "lo", "n", "anchor", "core", "hull")}
    hashes = RangeHash(values)
    at = np.arange(len(values) - spec.shingle + 1)
    code = (hashes.get(at, at + spec.shingle) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (_sliding_min(code, spec.reach)[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(starts)))
    lo, a = starts[head], anchor[head]
    core = hashes.get(a, a + spec.core)
    end = lo + n - 1 + spec.length
    other = RangeHash(values, 1)
    hull = mix(hashes.get(lo, end) ^ (other.get(lo, end) << np.uint64(1)) ^ ((a - lo).astype(np.uint64) << np.uint64(32)) ^ n.astype(np.uint64))
    return {"text": np.searchsorted(first, lo, "right") - 1, "lo": lo, "n": n, "anchor": a, "core": core.view(np.int64), "hull": hull.view(np.int64)}


def _hashed(spec: Spec, buf: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    values, _, _, first = spec.tokens(buf, at)
    return blocks(values, first, spec), first


def _counted(docs: DataFrame, spec: Spec) -> DataFrame:
    """Cores that occur more than once, and whether their hulls differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, at in chunks(batches, "text"):
            b, _ = _hashed(spec, buf, at)
            yield pa.RecordBatch.from_arrays([pa.array(b["core"]), pa.array(b["hull"])], ["core", "hull"])

    pairs = docs.select("text").mapInArrow(run, "core bigint, hull bigint")
    total = pairs.groupBy("core").agg(F.count("*").alias("total"), F.min("hull").alias("least"), F.max("hull").alias("most"))
    return total.filter("total > 1").select("core", (F.col("least") != F.col("most")).alias("mixed"))


def _placed(keyed: DataFrame, cores: DataFrame, spec: Spec) -> DataFrame:
    """The blocks of each distinct text whose core occurs more than once; ``copies`` counts equal texts."""
    shared = filter_of(cores.select("core"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = BlockedBloom(shared.value)
        for batch, buf, at in chunks(batches, "text"):
            b, first = _hashed(spec, buf, at)
            keep = known.might_hold(b["core"])
            b = {k: v[keep] for k, v in b.items()}
            whole, offsets = buffer_of(batch.column(0))
            keys = whole.reshape(-1, 16)[b["text"]] if len(offsets) > 1 else whole.reshape(-1, 16)
            yield pa.RecordBatch.from_arrays(
                [binary_array(keys.ravel(), np.full(len(b["text"]), 16)), pa.array(b["core"]), pa.array(b["hull"]), pa.array((b["lo"] - first[b["text"]]).astype(np.int32)), pa.array(b["n"].astype(np.int32)), pa.array((b["anchor"] - b["lo"]).astype(np.int32))],
                ["key", "core", "hull", "lo", "n", "left"],
            )

    rows = keyed.select("key", "text").mapInArrow(run, "key binary, core bigint, hull bigint, lo int, n int, left int")
    once = rows.groupBy("key", "core", "hull", "lo", "n", "left").agg(F.count("*").alias("copies"))
    return once.join(cores, "core")


def _texts(keyed: DataFrame, lists: DataFrame) -> DataFrame:
    """``lists`` (one row per key) with the text of each key, once however often the text occurs."""
    shared = filter_of(lists.select(F.xxhash64("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = BlockedBloom(shared.value)
        for batch in batches:
            keep = known.might_hold(np.asarray(batch.column(2)).astype(np.int64)) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["key", "text"])

    some = keyed.select("key", "text", F.xxhash64("key")).mapInArrow(run, "key binary, text string")
    return some.groupBy("key").agg(F.first("text").alias("text")).join(lists, "key")


def hulls(keyed: DataFrame, mixed: DataFrame, spec: Spec, cut: Callable, schema: str) -> DataFrame:
    """What ``cut`` makes of each distinct hull of a mixed core.

    ``cut`` gets tokens (values, start bytes, end bytes), the bytes, and arrays lo, n, left, core, copies, key of the hulls of a batch.
    """
    wanted = mixed.groupBy("core", "hull").agg(F.sum("copies").alias("copies"), F.min(F.struct("key", "lo", "n", "left")).alias("at"))
    lists = wanted.select(F.col("at.key").alias("key"), F.struct("core", "copies", "at.lo", "at.n", "at.left").alias("one")).groupBy("key").agg(F.collect_list("one").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        for batch, buf, at in chunks(batches, "text", 4 << 20):
            values, s, e, first = spec.tokens(buf, at)
            asked = batch.column(2)
            text = np.repeat(np.arange(batch.num_rows), np.asarray(asked.value_lengths()))
            rows = asked.flatten()
            core, copies, lo, n, left = (np.asarray(rows.field(i)) for i in range(5))
            keys = buffer_of(batch.column(0))[0].reshape(-1, 16)
            yield from cut(values, s, e, buf, {"start": first[text] + lo, "lo": lo, "n": n, "left": left, "core": core, "copies": copies, "key": keys[text]}, (task << 24) + count)
            count += 1

    return _texts(keyed, lists).select("key", "text", "asked").mapInArrow(run, schema)


def repeated_windows(keyed: DataFrame, spec: Spec, resolve: Callable[[DataFrame, DataFrame, Spec], DataFrame]) -> DataFrame:
    """(key, windows): the repeated windows (start, n) of each distinct text that has some, written."""
    cores = written(_counted(keyed, spec))
    placed = written(_placed(keyed, cores, spec))
    mixed = placed.filter("mixed").drop("mixed")
    # Written, so that the join below reads plain exchanges and Spark can split a hull that many texts share.
    equal = written(mixed.groupBy("core", "hull").agg(F.sum("copies").alias("all")).filter("all > 1").select("core", "hull"))
    windows = placed.filter("not mixed").select("key", F.col("lo").alias("start"), "n")
    windows = windows.union(mixed.join(equal, ["core", "hull"], "left_semi").select("key", "lo", "n"))
    windows = windows.union(resolve(keyed, mixed, spec))
    lists = written(windows.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("windows")))
    discard(cores, placed, equal)
    return lists


def covered(lists: DataFrame, length: int) -> DataFrame:
    """(key, n): how many tokens the windows of each text cover."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def grow(acc, x):
        start, end = x["start"].cast("long"), (x["start"] + x["n"] - 1 + length).cast("long")
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], start))).alias("n"))

    return lists.select("key", F.aggregate(F.array_sort("windows"), zero, grow, lambda acc: acc["n"]).alias("n"))


def remove(docs: DataFrame, spec: Spec, resolve: Callable[[DataFrame, DataFrame, Spec], DataFrame], join_with: bytes | None, also: Spec | None = None) -> DataFrame:
    """doc_id, n_tokens, n_removed, n_spans, kept_sha256 for each document.

    ``resolve`` gets the keyed texts and the blocks of mixed cores and returns repeated windows as
    (key, start, n).  ``join_with`` joins kept tokens; None keeps all other bytes as they are.  ``also`` adds n_shorter,
    the tokens in repeated windows of another length, which stay in the text.
    """
    docs = plain(docs, "doc_id", "text")
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    lists = repeated_windows(keyed, spec, resolve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch, buf, at in chunks(batches, "text", 4 << 20):
            _, s, e, first = spec.tokens(buf, at)
            lengths = np.asarray(batch.column(2).value_lengths())
            flat = batch.column(2).flatten()
            starts, counts = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
            ends = np.cumsum(lengths)
            removed, spans, hashes = [], [], []
            for i in range(batch.num_rows):
                x, y = starts[ends[i] - lengths[i] : ends[i]], counts[ends[i] - lengths[i] : ends[i]]
                x, y = covered_runs(x, x + y - 1 + spec.length)
                removed.append(int((y - x).sum()))
                spans.append(len(x))
                size = int(first[i + 1] - first[i])
                h = hashlib.sha256()
                if join_with is None:
                    for p, q in zip(np.append(0, y), np.append(x, size), strict=True):
                        h.update(buf[at[i] + p : at[i] + q])
                else:
                    keep = np.ones(size + 1, bool)
                    keep[ranges(x, y - x)] = False
                    k = first[i] + np.flatnonzero(keep[:size])
                    raw = buf.tobytes() if not i else raw
                    h.update(join_with.join([raw[p:q] for p, q in zip(s[k].tolist(), e[k].tolist(), strict=True)]))
                hashes.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())], ["key", "n_removed", "n_spans", "sha"])

    cut = _texts(keyed, lists).select("key", "text", "windows").mapInArrow(run, "key binary, n_removed bigint, n_spans bigint, sha string")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch, buf, at in chunks(batches, "text"):
            _, s, e, first = spec.tokens(buf, at)
            raw = buf.tobytes()
            if join_with is None:
                hashes = [hashlib.sha256(raw[p:q]).hexdigest() for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            else:
                pieces = [raw[p:q] for p, q in zip(s.tolist(), e.tolist(), strict=True)]
                hashes = [hashlib.sha256(join_with.join(pieces[p:q])).hexdigest() for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.array(hashes, pa.string())], ["doc_id", "key", "n_tokens", "whole_sha"])

    if also is not None:
        cut = cut.join(covered(repeated_windows(keyed, also, resolve), also.length).withColumnRenamed("n", "n_shorter"), "key", "full_outer")
    base = keyed.select("doc_id", "key", "text").mapInArrow(measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, n_tokens bigint, whole_sha string")
    zero = F.lit(0).cast("long")
    more = [F.coalesce("n_shorter", zero).alias("n_shorter")] if also is not None else []
    return base.join(cut, "key", "left").select("doc_id", "n_tokens", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole_sha").alias("kept_sha256"), *more)
