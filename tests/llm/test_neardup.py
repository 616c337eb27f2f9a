"""Near-duplicate groups against all pairs."""

import random

import numpy as np
import pytest

from lodestone.llm import neardup
from tests.llm.test_single_pass import same
from tests.llm.util import DOCS, corpus, frame, words


def brute(docs, k):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in docs:
        w = words(low(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, len(s), least[find(i)], d is not None and d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def edited(rng, n):
    """Chains and stars of near copies at similarities around the threshold."""
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.02, 0.05, 0.06, 0.1]))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((1000 * g + len(docs), rng.choice([" ", "\n "]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            if rng.random() < 0.5:
                base = w
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("k", [2, 5])
def test_groups(spark, k):
    docs = [(d, t) for d, t in [*corpus(), *edited(random.Random(k), 60)]]
    got = neardup.components(frame(spark, docs), shingle=k).collect()
    same(map(tuple, got), brute(docs, k))


def test_keep_one_and_empty(spark):
    docs = [(3, "a b c d e f g"), (2, "A b c d e f g"), (5, "other words here entirely"), (6, None), (7, ""), (None, "a b c d e f g")]
    out = neardup.keep_one(frame(spark, docs))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "5", "6", "7", "None"] and "key" in out.columns
    assert neardup.components(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one_keeps_one_row_of_repeated_ids(spark):
    same_set = "one two three four five six seven"
    # doc_id 4 carries two texts: one is a copy of document 1, the other stands alone and has to stay.
    docs = [(1, same_set), (1, same_set), (4, same_set.upper()), (4, "nothing like the others at all"), (9, "nothing like the others at all"), (None, same_set), (7, ""), (7, "")]
    out = neardup.keep_one(frame(spark, docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("1", same_set), ("4", "nothing like the others at all"), ("None", same_set), ("7", ""), ("7", "")])
    assert neardup.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_folded_edges_connect_the_same(spark):
    rng = random.Random(3)
    key = lambda k: k.to_bytes(16, "big")
    edges = [tuple(sorted(rng.sample(range(g * 100, g * 100 + 60), 2))) for g in range(8) for _ in range(45 * 30)]
    edges += [(900, k) for k in range(901, 40_000)] + [(950, k) for k in range(951, 40_000)]

    def groups(pairs):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in pairs:
            root[max(find(x), find(y))] = min(find(x), find(y))
        return {x: find(x) for x in root}

    df = spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary").repartition(5)
    got = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in neardup.folded(neardup.folded(df)).distinct().collect()]
    assert groups(got) == groups(edges) and all(a < b for a, b in got)
    assert len(got) < 1.05 * len(groups(edges))


def test_bounds_never_prune_what_reaches_the_threshold_often():
    limits = neardup._least_matches(80, neardup.MISS)
    rng = np.random.default_rng(0)
    for n, least in limits:
        assert (rng.binomial(n, 0.8, 200_000) < least).mean() < 1e-4
    assert limits[-1][1] > 0.5 * limits[-1][0]
