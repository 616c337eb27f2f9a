"""The Kneser-Ney model against a direct implementation, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

from lodestone.llm import perplexity
from tests.llm.util import DOCS, corpus, frame


def direct(trusted, order):
    """prob(byte, context) from texts, by the textbook."""
    led = [bytes([255]) * (order - 1) + t.encode() for t in trusted]
    tables = {order: Counter(t[k : k + order] for t in led for k in range(len(t) - order + 1))}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    totals, freed, discounts = {}, {}, {}
    for n, table in tables.items():
        m = Counter(table.values())
        y = m[1] / max(m[1] + 2 * m[2], 1)
        d = discounts[n] = [0, *(max(0.05, min(k - 0.05, k - (k + 1) * y * m[k + 1] / max(m[k], 1))) for k in (1, 2, 3))]
        totals[n], freed[n] = defaultdict(int), defaultdict(float)
        for g, c in table.items():
            totals[n][g[:-1]] += c
            freed[n][g[:-1]] += d[min(c, 3)]

    def prob(gram):
        if not gram:
            return 1 / 256
        n, context = len(gram), gram[:-1]
        low = prob(gram[1:])
        if not totals[n][context]:
            return low
        c = tables[n][gram]
        return ((c - discounts[n][min(c, 3)]) if c else 0) / totals[n][context] + freed[n][context] / totals[n][context] * low

    return prob


@pytest.mark.parametrize(("entries", "head", "short"), [(10**6, 0, 10**6), (5000, 300, 0), (500, 10**6, 10**6)])
def test_against_direct(spark, entries, head, short, monkeypatch):
    monkeypatch.setattr(perplexity, "SHORT_ENTRIES", short)
    texts = [t for _, t in corpus() if t][:30]
    top = perplexity.written(perplexity.counts(frame(spark, list(enumerate(texts))), 4))
    table = perplexity.written(perplexity.model(top, 4))
    prob = direct(texts, 4)
    asked = [*texts[:3], "something else Ü", texts[5][:40], "", "zz"]
    docs = spark.createDataFrame([(i, "en" if t != "zz" else "none", t) for i, t in enumerate(asked)], "doc_id long, lang string, text string").repartition(3)
    known = perplexity._head(table, top, 4, entries, head) if head else None
    assert known is None or 0 < sum(len(x[0]) for x in known.value.values()) <= head
    got = perplexity.perplexities(docs, table, 4, entries, known).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(asked)))
    for r in got:
        led = bytes([255]) * 3 + asked[r.doc_id].encode()
        want = sum(math.log2(prob(led[k - 3 : k + 1]) if r.lang == "en" else 1 / 256) for k in range(3, len(led)))
        assert math.isclose(r.log2, want, rel_tol=1e-9, abs_tol=1e-9) and r.n_bytes == len(led) - 3


def test_thresholds_and_verdicts_against_direct(spark):
    docs = [(i, g, t) for i, (g, t) in enumerate(duckdb.sql("select lang, text from '/root/testdata/sf0.001/documents.parquet' where strlen(text) between 1 and 1500").fetchall())]
    trusted = {i for i, _, _ in docs if i % 3}
    folds = {r.doc_id: r.f for r in spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id int, text string").selectExpr("doc_id", "pmod(xxhash64(text), 2) as f").collect()}
    models = {}
    for i, g, t in docs:
        if i in trusted:
            models.setdefault((1 - folds[i], g), []).append(t)
    assert all((f, g) in models for _, g, _ in docs for f in (0, 1))
    models = {k: direct(v, 3) for k, v in models.items()}
    want = {}
    for i, g, t in docs:
        led = bytes([255]) * 2 + t.encode()
        prob = models[folds[i], g]
        want[i] = round(2 ** -(sum(math.log2(prob(led[k - 2 : k + 1])) for k in range(2, len(led))) / (len(led) - 2)), 6)
    limit = {}
    for g in {g for _, g, _ in docs}:
        steps = sorted(math.ceil(math.log(want[i]) * 10_000) for i, x, _ in docs if x == g and i in trusted)
        limit[g] = math.exp(steps[math.ceil(len(steps) * 0.9) - 1] / 10_000) * 1.01
    table = spark.createDataFrame(docs, "doc_id int, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id int, quality int, toxic int")
    out = perplexity.classify(table, labels, order=3, quantile=0.9, slack=1.01, shard_entries=2000, head_entries=500).collect()
    assert len(out) == len(docs)
    for r in out:
        g = docs[r.doc_id][1]
        assert abs(r.perplexity - want[r.doc_id]) < 2e-6 and abs(r.threshold - limit[g]) < 3e-4 * limit[g] and r.kept == (r.perplexity <= r.threshold)
    assert 0 < sum(r.kept for r in out) < len(out)


def test_separates_junk_and_keeps_clean(spark):
    d = "/root/testdata/sf0.01"
    out = perplexity.classify(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
    kept = {r.doc_id: r.kept for r in out}
    labels = duckdb.sql(f"select doc_id, quality, toxic from '{d}/labels.parquet'").fetchall()
    good = [kept[i] for i, q, t in labels if q == 1 and t == 0]
    bad = [kept[i] for i, q, t in labels if q == 0]
    # Every document is scored by the model of the other fold, so this is held-out accuracy.
    assert len(out) == 1000 and sum(good) / len(good) > 0.97 and (sum(good) + len(bad) - sum(bad)) / (len(good) + len(bad)) > 0.95


def test_odd_inputs(spark):
    rows = [(1, "abc abc abc", None), (2, None, "en"), (3, "", "en"), (None, "abd", "en"), (1, "abc abc abc", None), (4, "zzz", "xx")]
    docs = spark.createDataFrame([(i, t, g, 1, 2) for i, t, g in rows], "doc_id long, text string, lang string, gram int, fold int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for entries in (10**6, 3):
        out = perplexity.classify(docs, labels, shard_entries=entries).collect()
        assert len(out) == 6 and [r.kept for r in out if r.doc_id in (2, 3)] == [False, False]
    assert all(r.kept for r in perplexity.classify(docs, labels.limit(0)).collect() if r.perplexity is not None)
    assert perplexity.classify(spark.createDataFrame([], DOCS), labels).count() == 0


@pytest.mark.parametrize("entries", [10**6, 3000])
def test_languages_without_models(spark, entries):
    clean = [f"the {a} of the {b} is in the {c}" for a in ("house", "garden", "river", "tower") for b in ("town", "king", "valley") for c in ("north", "south", "east", "west")]
    junk = ["\u00a7%&#" * 8 + str(k) for k in range(6)]
    # xx has no trusted document, yy those of one fold only, en many.
    texts = [t for t in clean if t]
    folds = {r.text: r.f for r in spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "pmod(xxhash64(text), 2) as f").collect()}
    yy = [t for t in texts[36:] if folds[t] == 0][:4]
    rows = [(k, t, "en") for k, t in enumerate(texts[:36])] + [(100 + k, t, "yy") for k, t in enumerate(yy)]
    trusted = [r[0] for r in rows]
    rows += [(200 + k, t, "xx") for k, t in enumerate(texts[36:])] + [(300 + k, t, "xx") for k, t in enumerate(junk)] + [(400 + k, t, "yy") for k, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in perplexity.classify(docs, labels, shard_entries=entries).collect()}
    assert len(out) == len(rows) and len(yy) > 1
    clean_xx = [r for i, r in out.items() if 200 <= i < 300]
    assert all(r.perplexity < 30 for r in clean_xx) and sum(r.kept for r in clean_xx) >= 0.75 * len(clean_xx)
    assert not any(out[i].kept for i in out if i >= 300)
    assert all(out[i].perplexity < 30 for i in out if 100 <= i < 200)
    # Repeated rows of trusted documents are not scored into the result twice.
    assert sorted(out) == sorted(i for i, _, _ in rows)
