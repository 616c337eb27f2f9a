"""Both substring operators against brute force, with short lengths and many repeats."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import fmindex, repeats, suffixes
from tests.llm.test_single_pass import same
from tests.llm.util import DOCS, corpus, frame, words


def brute(docs, cut, join, n):
    seqs = [(i, cut(t)) for i, t in docs]
    seen = Counter(tuple(w[k : k + n]) for _, w in seqs for k in range(len(w) - n + 1))
    for i, w in seqs:
        gone = {j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        kept = join([x for k, x in enumerate(w) if k not in gone])
        yield i, len(w), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest()


def patched(rng, n_docs, alphabet, passages, copies):
    """Texts of random words into which passages of random length are copied, whole and cut, at random places."""
    docs = []
    pool = [[rng.choice(alphabet) for _ in range(rng.randint(30, 90))] for _ in range(passages)]
    for i in range(n_docs):
        w = [rng.choice(alphabet) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, copies)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            k = rng.randint(0, len(w))
            w[k:k] = p[a : rng.randint(a, len(p))]
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    return docs + [docs[0], (None, docs[1][1]), (None, None), (7, "")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_passages(spark, seed):
    rng = random.Random(seed)
    docs = patched(rng, 60, [f"w{k}" for k in range(400)], 8, 3) + patched(rng, 20, ["a", "b"], 4, 3)
    df = frame(spark, docs).repartition(5)
    got = [tuple(r) for r in suffixes.remove_repeats(df, 60).collect()]
    same(got, list(brute(docs, lambda t: (t or "").encode(), bytes, 60)))
    both = suffixes.remove_repeats(df, 60, shorter=25).collect()
    same([tuple(r)[:5] for r in both], got)
    same([(r.doc_id, r.n_bytes, r.n_shorter) for r in both], [x[:3] for x in brute(docs, lambda t: (t or "").encode(), bytes, 25)])
    got = [tuple(r) for r in fmindex.remove_repeats(df, 12).collect()]
    same(got, [(i, n, r, h) for i, n, r, _, h in brute(docs, words, lambda x: " ".join(x).encode(), 12)])


def test_production_lengths(spark):
    docs = corpus()
    df = frame(spark, docs)
    same([tuple(r) for r in fmindex.remove_repeats(df).collect()], [(i, n, r, h) for i, n, r, _, h in brute(docs, words, lambda x: " ".join(x).encode(), 35)])
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[k : k + 400] for _, t in raw for k in range(len(t) - 399))
    want = []
    for i, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        left = np.frombuffer(t, np.uint8)[~gone[: len(t)]].tobytes()
        want.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    same([tuple(r) for r in suffixes.remove_repeats(df).collect()], want)


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert suffixes.remove_repeats(none).count() == 0 and fmindex.remove_repeats(none).count() == 0


@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), max_size=6))
@settings(deadline=None, max_examples=150)
def test_loser_tree(runs):
    def coded(run):
        last = b""
        for x in sorted(run):
            yield suffixes.common_prefix(last, x) if last or True else 0, x, None
            last = x

    out = [(p, x) for p, x, _ in suffixes.LoserTree([coded(r) for r in runs])]
    assert [x for _, x in out] == sorted(x for r in runs for x in r)
    assert all(p == suffixes.common_prefix(a, b) for (_, a), (p, b) in zip(out, out[1:], strict=False))


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 5))
@settings(deadline=None, max_examples=100)
def test_backward_search(symbols, n):
    text = np.array([*symbols, 0], np.int64)
    index = fmindex.FMIndex(text, n + 1)
    starts = np.arange(max(0, len(symbols) - n + 1))
    grams = [tuple(symbols[k : k + n]) for k in starts]
    assert index.occurring(text, starts, n).tolist() == [k for k, g in enumerate(grams) if grams.count(g) > 1]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, 3000).astype(np.uint64)
    x[2000:2100] = x[100:200]
    b = repeats.blocks(x, np.array([0, 3000]), repeats.Spec(None, 50, 20, 4))
    place = {int(p): int(a - p) for lo, n, a in zip(b["lo"], b["n"], b["anchor"], strict=True) for p in range(lo, lo + n)}
    assert all(place[p] == place[p + 1900] for p in range(100, 151)) and len(place) == 2951
