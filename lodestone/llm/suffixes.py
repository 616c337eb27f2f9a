"""Removal of repeated 400-byte strings by a common-prefix-aware merge sort of suffixes.

Every 400-byte window holds an anchor (see ``repeats``); the suffixes that start at anchors of mixed
cores are sorted.  Each task sorts its own suffixes into runs and front-codes them: a suffix is sent as
the length of the prefix it shares with the one before, and the rest.  The receiving task merges its
runs with a loser tree that knows, for every waiting suffix, the prefix it shares with the last one
given out, and so never compares a known prefix again.  The merge yields each suffix with its common
prefix; windows are repeated where the right contexts (from the sorted suffixes) and the left contexts
of two anchors agree over 400 bytes together.

Defined results: null and empty texts have no bytes and lose none; equal rows repeat each other's
strings; touching removed spans count as one; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import repeats
from lodestone.llm.common import whole_groups

LENGTH = 400
#: A passage of fifty words is shorter than that in most languages; repeats from this length on are counted beside.
SHORTER = 250
#: Suffixes of one run at most, and those resolved together at least.
RUN_ROWS = 20_000
RESOLVE_ROWS = 40_000


def _bytes(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return buf.astype(np.uint64) + np.uint64(1), None, None, at


def spec(length: int = LENGTH) -> repeats.Spec:
    return repeats.Spec(_bytes, length, length // 2 + 1, min(8, length // 2))


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that ``known`` bytes agree."""
    m = min(len(x), len(y))
    a, b = x[known:m], y[known:m]
    if a == b:
        return m
    d = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return m - (d.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (shared prefix with the one before in the run, string, payload)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.k = 1
        while self.k < max(1, len(runs)):
            self.k *= 2
        self.runs = [*runs, *([iter(())] * (self.k - len(runs)))]
        # For each run: the prefix its head shares with the last string given out, or with the winner that beat it.
        self.shared = [0] * self.k
        self.head: list[tuple[int, bytes, object] | None] = [next(r, None) for r in self.runs]
        self.losers = [0] * self.k
        self.losers[0] = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of two runs; the loser stays at the node."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            win, lose = (a, b) if y is None else (b, a)
        elif self.shared[a] != self.shared[b]:
            win, lose = (a, b) if self.shared[a] > self.shared[b] else (b, a)
        else:
            p = common_prefix(x[1], y[1], self.shared[a])
            less = x[1][p : p + 1] <= y[1][p : p + 1]
            win, lose = (a, b) if less else (b, a)
            self.shared[lose] = p
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """(prefix shared with the string before, string, payload) in order."""
        while (top := self.head[win := self.losers[0]]) is not None:
            yield self.shared[win], top[1], top[2]
            self.head[win] = new = next(self.runs[win], None)
            self.shared[win] = new[0] if new is not None else 0
            node, cur = (win + self.k) // 2, win
            while node:
                cur = self._play(node, cur, self.losers[node])
                node //= 2
            self.losers[0] = cur


def repeated(prefix: np.ndarray, lefts: list[bytes], right: np.ndarray, alone: np.ndarray, n: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated windows of sorted anchors: index of the anchor, and distance of the window's start to its left.

    ``prefix``: bytes shared with the suffix before; ``lefts``: what stands before each anchor in its hull;
    ``alone``: whether the hull has one copy, so that its windows are open.
    """
    g = len(prefix)
    group = np.cumsum(prefix < core)
    left_size = np.fromiter(map(len, lefts), np.int64, g)
    back = [x[::-1] for x in lefts]
    order = np.array(sorted(range(g), key=lambda i: (group[i], back[i])), np.int64)
    same = np.zeros(g, np.int64)
    for k in range(1, g):
        i, j = order[k - 1], order[k]
        same[k] = common_prefix(back[i], back[j]) if group[i] == group[j] else -1
    same[0] = -1
    anchors, distances = [], []
    for o in range(int(left_size.max(initial=0)) + 1):
        run = np.cumsum(prefix < length - o)
        kind = np.empty(g, np.int64)
        kind[order] = np.cumsum(same < o)
        fits = (left_size >= o) & (right >= length - o)
        wanted = fits & alone & (left_size - o < n)
        if not wanted.any():
            continue
        some = np.flatnonzero(fits)
        code = run[some] * (g + 1) + kind[some]
        by = np.argsort(code, kind="stable")
        c = code[by]
        twin = np.zeros(len(c), bool)
        twin[1:] = c[1:] == c[:-1]
        twin[:-1] |= twin[1:]
        hit = some[by[twin]]
        hit = hit[wanted[hit]]
        anchors.append(hit)
        distances.append(np.full(len(hit), o))
    if not anchors:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(anchors), np.concatenate(distances)


_RUN = "bucket int, run bigint, seq int, shared int, tail binary, before binary, n int, copies int, lo int, key binary"


def resolve(keyed: DataFrame, mixed: DataFrame, spec: repeats.Spec) -> DataFrame:
    """Repeated windows (key, start, n) of the hulls of mixed cores that have one copy."""
    parts = 4 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def front_coded(values, s, e, buf, asked, run) -> Iterator[pa.RecordBatch]:
        raw = buf.tobytes()
        start, left, n = asked["start"], asked["left"], asked["n"]
        at, end = (start + left).tolist(), (start + n - 1 + spec.length).tolist()
        bucket = (asked["core"] % parts).tolist()
        suffix = [raw[i:j] for i, j in zip(at, end, strict=True)]
        order = sorted(range(len(suffix)), key=lambda i: (bucket[i], suffix[i]))
        start = start.tolist()
        for k in range(0, len(order), RUN_ROWS):
            some = order[k : k + RUN_ROWS]
            shared = [0 if not j or bucket[i] != bucket[some[j - 1]] else common_prefix(suffix[some[j - 1]], suffix[i]) for j, i in enumerate(some)]
            ints = lambda a: pa.array(np.asarray(a)[some].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ints(bucket), pa.array(np.full(len(some), (run << 12) + k // RUN_ROWS)), pa.array(np.arange(len(some), dtype=np.int32)), pa.array(shared, pa.int32()), pa.array([suffix[i][p:] for i, p in zip(some, shared, strict=True)], pa.binary()),
                 pa.array([raw[start[i] : at[i]] for i in some], pa.binary()), ints(n), ints(np.minimum(asked["copies"], 2)), ints(asked["lo"]), pa.array([asked["key"][i].tobytes() for i in some], pa.binary())],
                [x.split()[0] for x in _RUN.split(", ")],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def settle() -> Iterator[pa.RecordBatch]:
            prefix, size, info = (list(x) for x in zip(*held, strict=True))
            lefts, n, copies, lo, key = (list(x) for x in zip(*info, strict=True))
            a, o = repeated(np.array(prefix), lefts, np.array(size), np.array(copies) == 1, np.array(n), spec.length, spec.core)
            if len(a):
                place = np.array(lo)[a] + np.fromiter(map(len, lefts), np.int64, len(lefts))[a] - o
                order = np.lexsort((place, a))
                a, place = a[order], place[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (place[1:] != place[:-1] + 1)
                head = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array([key[i] for i in a[head]], pa.binary()), pa.array(place[head].astype(np.int32)), pa.array(np.diff(np.append(head, len(a))).astype(np.int32))], ["key", "start", "n"])
            held.clear()

        for table in whole_groups(batches, "bucket"):
            columns = [table.column(c).to_pylist() for c in ("bucket", "run", "shared", "tail", "before", "n", "copies", "lo", "key")]
            buckets, run_ids = np.array(columns[0]), np.array(columns[1])
            cut = np.flatnonzero(np.concatenate(([True], (buckets[1:] != buckets[:-1]) | (run_ids[1:] != run_ids[:-1]), [True])))

            def stream(i: int, j: int) -> Iterator[tuple[int, bytes, object]]:
                last = b""
                for k in range(i, j):
                    shared = columns[2][k] if k > i else 0
                    last = last[: columns[2][k]] + columns[3][k]
                    yield shared, last, tuple(c[k] for c in columns[4:])

            runs: dict[int, list] = {}
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                runs.setdefault(int(buckets[i]), []).append(stream(i, j))
            for some in runs.values():
                for shared, suffix, info in LoserTree(some):
                    if shared < spec.core and len(held) >= RESOLVE_ROWS:
                        yield from settle()
                    held.append((shared, len(suffix), info))
        if held:
            yield from settle()

    runs = repeats.hulls(keyed, mixed, spec, front_coded, _RUN)
    dealt = runs.repartition(F.col("bucket")).sortWithinPartitions("bucket", "run", "seq")
    return dealt.mapInArrow(merge, "key binary, start int, n int")


def remove_repeats(docs: DataFrame, length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document.

    With ``shorter`` also n_shorter: the bytes in strings of that length that start anywhere else too; they are not removed.
    """
    return repeats.remove(docs, spec(length), resolve, None, None if shorter is None else spec(shorter)).withColumnRenamed("n_tokens", "n_bytes")
