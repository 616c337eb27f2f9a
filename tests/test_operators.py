"""Single operators on hand-built rows."""

import hashlib
import math
import random
import re
import sqlite3
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.scratch import written
from lodestone.functions.sparse import Best
from lodestone.operators import admission, chunking, concepts, graph, history, ranking
from lodestone.plans import corpus
from lodestone.sources import git, parsers
from lodestone.streaming import refresh
from tests.llm.util import SF


def test_fusion_ties_go_to_the_smaller_unit(spark):
    rows = [(1, c, u, k + 1) for c, units in (("a", [1, 2, 3]), ("b", [2, 1, 4])) for k, u in enumerate(units)]
    out = ranking.fuse(spark.createDataFrame([*rows, (1, "a", 1, 9)], "query_id long, channel string, unit_id long, rank int")).orderBy("rank").collect()
    assert [r.unit_id for r in out] == [1, 2, 3, 4] and [r["rank"] for r in out] == [1, 2, 3, 4]


def test_bm25_against_full_text_index(spark):
    texts = [("alpha beta beta", "x"), ("alpha gamma", "alpha"), ("delta", "beta beta"), ("beta " * 9, "y"), ("alpha alpha", "z"), ("omega", "q")]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(evidence_text, routing_text)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    db.executemany("insert into f(rowid, evidence_text, routing_text) values (?, ?, ?)", [(i + 1, *t) for i, t in enumerate(texts)])
    units = spark.createDataFrame([(i + 1, *t) for i, t in enumerate(texts)], "unit_id long, evidence_text string, routing_text string")
    for q in ("alpha", "alpha beta", "beta beta gamma"):
        match = "evidence_text : (" + " OR ".join(f'"{w}"' for w in q.split()) + ")"
        want = db.execute("select rowid, -bm25(f) from f where f match ? order by bm25(f), rowid", (match,)).fetchall()
        got = ranking.top(ranking.bm25(units, spark.createDataFrame([(1, q)], "query_id long, text string"), ["evidence_text"], ["evidence_text", "routing_text"]), 25).orderBy("rank").collect()
        assert [r.unit_id for r in got] == [i for i, _ in want]
        assert all(math.isclose(r.score, s, rel_tol=1e-9, abs_tol=1e-12) for r, (_, s) in zip(got, want, strict=True))


POOL = "query_id long, unit_id long, place int, source_kind string, role string, source_id string, commit string, path string, symbol string, part int, content_hash string, token_count long, credible boolean, required array<string>, embedding array<double>"


def admitted(spark, rows, **limits):
    base = {"query_id": 1, "source_kind": "code", "role": "current_truth", "commit": None, "path": None, "symbol": None, "part": 0, "token_count": 1, "credible": True, "required": ["current_truth", "curated_memory"], "embedding": None}
    names = [c.split()[0] for c in POOL.split(", ")]
    full = [base | {"unit_id": k, "place": k, "source_id": f"s{k}", "content_hash": f"h{k}"} | r for k, r in enumerate(rows, 1)]
    out = admission.admit(spark.createDataFrame([tuple(r[n] for n in names) for r in full], POOL), admission.Limits(**limits)).orderBy("position").collect()
    return [r.unit_id for r in out]


def test_admission_budget_and_hashes(spark):
    assert admitted(spark, [{"token_count": 10}, {"token_count": 2}, {"token_count": 3}], max_tokens=5) == [2, 3]
    assert admitted(spark, [{"token_count": 10}], max_tokens=5) == []
    assert admitted(spark, [{"content_hash": "x"}, {"content_hash": "x"}]) == [1]
    # The hash of a unit that was too long is remembered.
    assert admitted(spark, [{"content_hash": "x", "token_count": 9}, {"content_hash": "x"}], max_tokens=5) == []


def test_admission_caps(spark):
    assert admitted(spark, [{"source_id": "a"}] * 15 + [{}, {}]) == [1, 2, 3, 16, 17]
    assert admitted(spark, [{"source_id": "a"}] * 2, per_source=0) == [1]
    memory = {"role": "curated_memory", "source_kind": "hindsight_memory", "required": []}
    assert len(admitted(spark, [memory] * 7)) == 5
    commit = {"source_kind": "git_commit", "role": "change_origin", "commit": "c", "required": []}
    assert len(admitted(spark, [commit | {"path": p} for p in "abc"])) == 2
    assert len(admitted(spark, [commit | {"path": "a"}] * 2)) == 1
    assert admitted(spark, [commit | {"credible": False}, {}]) == [2]
    assert admitted(spark, [{"embedding": [1.0, 0.0]}, {"embedding": [1.0, 0.01]}, {"embedding": [0.0, 1.0]}]) == [1, 3]
    assert len(admitted(spark, [{}] * 40)) == 30


def test_locale_siblings(spark):
    units = spark.createDataFrame([(i, "markdown", f"docs/{x}/docs/tutorial/first-steps.md") for i, x in enumerate(["ja", "en", "zh", "zh-hant"])] + [(9, "markdown", "README.md")], "unit_id long, source_kind string, locator string")
    pool = spark.createDataFrame([(1, i, p, 1) for p, i in enumerate([0, 1, 2, 3, 9])], "query_id long, unit_id long, place int, coverage int")
    # No language is preferred: of equal coverage the first place stays, but for a locator without a locale.
    assert sorted(r.unit_id for r in graph.suppress_siblings(pool, units).collect()) == [0, 9]
    canonical = spark.createDataFrame([(5, "markdown", "docs/docs/tutorial/first-steps.md")], units.schema)
    more = pool.union(spark.createDataFrame([(1, 5, 6, 1)], pool.schema))
    assert sorted(r.unit_id for r in graph.suppress_siblings(more, units.union(canonical)).collect()) == [5, 9]
    best = more.union(spark.createDataFrame([(2, 5, 1, 1), (2, 3, 2, 2)], pool.schema))
    assert sorted(r.unit_id for r in graph.suppress_siblings(best, units.union(canonical)).filter("query_id = 2").collect()) == [3]


def test_times(spark):
    now = 1_700_000_000
    ages = {0: "0m ago", 3599: "59m ago", 3600: "1h ago", 86399: "23h ago", 86400: "2023-11-13 (1d ago)", 364 * 86400: "2022-11-15 (364d ago)", 365 * 86400: "2022-11-14"}
    rows = spark.createDataFrame([(a, now - a) for a in ages], "age long, t long").select("age", T.render_time(F.col("t"), F.lit(now).cast("long")).alias("s")).collect()
    assert {r.age: r.s for r in rows} == ages


def test_split_oversized():
    text = "One. Two.\nThree four five six"
    pieces = chunking.split_oversized(text, 12)
    assert "".join(p for p, _, _ in pieces) == text and all(len(p) <= 12 and text[s:e] == p for p, s, e in pieces) and pieces[0][0] == "One. Two.\n"


def test_text_and_markdown():
    atoms = parsers.parse_text("é one\r\nmore\r\n\r\n two\n", "t")
    raw = "é one\r\nmore\r\n\r\n two\n".encode()
    assert [a.text for a in atoms[1:]] == ["é one\r\nmore", " two"] and all(raw[a.start : a.end].decode() == a.text for a in atoms)
    text = "# A\n\npara `x`\nstill\n\n## B\n- one\n- two\n  # not a heading\n\n> quote\n\n```py\n# code\n```\nC\n=\nend\n"
    atoms = parsers.parse_markdown(text, "t")
    assert [a.kind for a in atoms] == ["document", "heading", "paragraph", "heading", "list", "list_item", "list_item", "block_quote", "code_block", "heading", "paragraph"]
    assert atoms[4].breadcrumb == "t > A > B" and atoms[-1].breadcrumb == "t > C"
    assert all(text.encode()[a.start : a.end].decode() == a.text for a in atoms)


CODE = {
    "a.py": ("import os\nclass A:\n    # why\n    def f(self):\n        return os\n\ndef g(): pass\n", ["os", "A", "f", "g"]),
    "a.rs": ("use std::io;\nimpl T for X {\n    fn f(&self) {}\n}\npub struct S { a: u8 }\n", ["std::io", "T for X", "f", "S"]),
    "a.ts": ("import x from 'y';\nexport class A {\n  run() {\n  }\n}\nconst f = (a) => a;\n", ["x from 'y';", "A", "run", "f"]),
    "a.go": ("package p\nfunc (r *R) M() {\n}\ntype S struct {\n}\n", ["R.M", "S"]),
    "A.java": ("import a.b;\nclass A {\n  public int f(int x) {\n    return x;\n  }\n}\n", ["a.b", "A", "f"]),
    "a.c": ('#include "x.h"\nint main(void) {\n  return 0;\n}\n', ['"x.h"', "main"]),
    "a.cpp": ("namespace n {\nint A::f() {\n  return 1;\n}\n}\n", ["n", "A::f"]),
    "a.cs": ("using System;\nnamespace N {\n  class C {\n    public void M() {\n    }\n  }\n}\n", ["System", "N", "C", "M"]),
    "a.rb": ("require 'x'\nmodule M\n  def self.f\n  end\nend\n", ["'x'", "M", "self.f"]),
    "a.php": ("<?php\nnamespace A;\nclass B {\n  function f() {\n  }\n}\n", ["A", "B", "f"]),
    "a.sh": ("source ./x.sh\nf() {\n  echo\n}\n", ["./x.sh", "f"]),
    "a.gd": ('extends "res://x.gd"\nfunc f():\n\tpass\nvar y = 1\n', ['"res://x.gd"', "f", "y"]),
    "a.tscn": ('[node name="N" type="X"]\nk = 1\n', ["N"]),
    "tool": ("#!/usr/bin/env bash\nf() {\n}\n", ["f"]),
}


@pytest.mark.parametrize("name", CODE)
def test_code(name):
    text, names = CODE[name]
    atoms = parsers.parse_code(text, name)
    assert [a.name for a in atoms[1:]] == names
    assert all(text.encode()[a.start : a.end].decode() == a.text for a in atoms)
    assert [a.kind for a in parsers.parse_code("x = {{{ ((", name)]


def test_hunks():
    patch = "diff --git a/x b/x\n@@ -1,3 +1,3 @@ f\n a\n-b\n+c\n d\n@@ -9 +9,2 @@\n x\n+y\n"
    hunks = git.parse_hunks(patch)
    assert [h[:4] for h in hunks] == [(1, 3, 1, 3), (9, 1, 9, 2)]
    assert git.changed_lines(hunks[0][4]) == [2] and git.changed_lines(hunks[0][4], "old") == [2] and git.changed_lines(hunks[1][4]) == [10]
    assert git.parse_log("a\x1fx\x1fm\x1e\nb\x1f7\x1fn o\n\x1e") == [("a", 0, "m"), ("b", 7, "n o")]


def test_alignment_takes_the_smallest_span(spark):
    spans = spark.createDataFrame([("p", 1, 200, "outer"), ("p", 60, 70, "b"), ("p", 60, 70, "a")], "path string, start_line long, end_line long, breadcrumb string")
    lines = spark.createDataFrame([("p", 5), ("p", 65), ("p", 300), ("q", 5)], "path string, line long")
    assert {(r.line, r.breadcrumb) for r in history.align_lines(lines, spans).collect()} == {(5, "outer"), (65, "a")}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"locator": "a", "text": "one\\n\\ntwo"}\n')
    refresh.refresh_units(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/2.json").write_text('{"locator": "a", "text": "zero", "version": 1}\n{"locator": "a", "text": "three", "version": 2}\n{"locator": "b", "text": "four"}\n')
    refresh.refresh_units(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.evidence_text for r in refresh.current_units(spark, str(tmp_path / "store")).collect()) == ["four", "three"]
    seen = []
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.json").write_text('{"session": "s", "line_no": 1, "type": "message", "text": "a"}\n{"session": "s", "line_no": 2, "type": "compaction"}\n{"session": "s", "line_no": 3, "type": "message", "text": "b"}\n')
    refresh.sealed_turns(spark, str(tmp_path / "log"), str(tmp_path / "cp2"), lambda df: seen.append(df.count()), str(tmp_path / "h")).awaitTermination()
    # The next batch reads its own sessions only: s is sealed further on, t not at all.
    (tmp_path / "log/2.json").write_text('{"session": "s", "line_no": 4, "type": "compaction"}\n{"session": "t", "line_no": 1, "type": "message", "text": "c"}\n')
    refresh.sealed_turns(spark, str(tmp_path / "log"), str(tmp_path / "cp2"), lambda df: seen.append(df.count()), str(tmp_path / "h")).awaitTermination()
    assert seen == [2, 4]


def test_names_of_no_other_part_in_the_library():
    import pathlib

    import lodestone

    root = pathlib.Path(lodestone.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"lodestone\.llm|from lodestone import llm", p.read_text()), p


def test_concepts_of_all_pairs_without_a_join(spark):
    texts = ["Alpha beta.", "xalpha, gamma", "foo-bar_baz qux", "foo bar", "pre-foo-bar!", "\u00e9tude\u00a0alpha,x", "", None, "the snake_case\nfoo"]
    asked = ["the alpha", "alpha, beta", "foo-bar", "foo-bar qux", "snake_case x", "\u00c9TUDE the", "", "of the", "-foo- --", "fooBar, foobar,"]
    units = spark.createDataFrame(list(enumerate(texts)), "unit_id long, text string")
    rows = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string").select("query_id", T.concepts(F.col("text")).alias("concepts"))
    # Each concept against each text, one by one.
    pairs = units.crossJoin(rows).withColumn("c", F.explode("concepts"))
    hit = pairs.filter(T.matches(F.col("c"), F.lower("text"), T.terms(F.col("text")))).groupBy("query_id", "unit_id").agg(F.count("*").alias("n"), F.bool_or("c.identifier").alias("i"), F.first(F.size("concepts")).alias("total"))
    want = {(r.query_id, r.unit_id, r.n, r.i or r.n >= min(2, r.total)) for r in hit.collect()}
    out = concepts.credible_pairs(units, rows)
    found = [tuple(r) for r in out.collect()]
    assert set(found) == want and len(found) == len(want) > 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert concepts.credible_pairs(units, rows.limit(0)).count() == 0 and concepts.credible_pairs(units.limit(0), rows).count() == 0


def test_sessions_of_symbols_are_dealt_by_unit(spark, monkeypatch):
    rows = [(u, "file", f"f{u % 2}", "defined_in" if u < 6 else "touched") for u in range(40)] + [(u, "symbol", f"n{u % 4}", "defines") for u in range(6)]
    anchors = spark.createDataFrame(rows + rows[:9] + rows[30:], "unit_id long, kind string, value string, relationship string")
    units = spark.createDataFrame([(u, "code" if u < 6 else "agent_session") for u in range(38)], "unit_id long, source_kind string")
    home = {(f"n{u % 4}", f"f{u % 2}") for u in range(6)}
    want = sorted((s, f, u) for s, f in home for u in range(6, 38) if f == f"f{u % 2}")
    out = graph.sessions_of_symbols(anchors, units)
    assert sorted(map(tuple, out.collect())) == want
    # The pairs themselves are not shuffled, and AQE may not put all units into one task.
    assert out.rdd.getNumPartitions() >= 32
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.index("Join Inner") < plan.index("Deduplicate")
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 100)
    assert sorted(map(tuple, graph.sessions_of_symbols(anchors, units).collect())) == want


def test_cosine_top_holds_few_scores_at_once(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(u, [float(draw.randrange(-2, 3)) for _ in range(3 if u % 17 else 2)] if u % 13 else None) for u in range(400)]
    vectors = spark.createDataFrame([(399 - u, v) for u, v in rows], "unit_id long, embedding array<float>").coalesce(1)
    asked = [(u, v) for u, v in rows if v and len(v) == 3][:30]
    def cosine(a, b):
        norm = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0
    scored = {q: sorted((-round(cosine(v, w), 9), 399 - u) for u, w in rows if w and len(w) == 3) for q, v in asked}
    monkeypatch.setattr(ranking, "CELLS", 64)
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    for n in (1, 7, 1000):
        got = ranking.cosine_top(vectors, queries, n, 16).collect()
        assert sorted((r.query_id, r["rank"], r.unit_id, -round(r.score, 9)) for r in got) == sorted((q, k + 1, u, s) for q, x in scored.items() for k, (s, u) in enumerate(x[:n]))
    assert ranking.cosine_top(vectors, queries, None, 16).count() == sum(map(len, scored.values()))


def test_best_cuts_at_every_put():
    best = Best(2, 3)
    for k in range(0, 3000, 100):
        best.put(np.zeros(100, int), np.arange(k, k + 100), np.full(100, 0.5))
        assert len(best.unit) == 3
    assert list(best.unit) == [0, 1, 2] and not best.may_enter(np.array([[0.4, 0.4]]))[0, 0] and best.may_enter(np.array([[0.5, 0.0]])).all()


def test_bm25_scores_units_where_they_are(spark, monkeypatch):
    draw = random.Random(3)
    words = ["a", "b", "caf\u00e9", "cafe", "d", "e", "f", "g"]
    say = lambda k: " ".join(draw.choice(words) for _ in range(draw.randrange(k)))
    rows = [(u, say(9) if u % 7 else None, say(4), "t" if u % 5 == 0 else "o" if u % 5 == 1 else None, u % 3 > 0) for u in range(90)] + [(None, "a b", "a", None, True), (3, "a a g", "b", None, True)]
    asked = [(q, say(6), q % 2) for q in range(40)] + [(100, "", 0), (101, "zz", 0)]
    units = spark.createDataFrame(rows, "unit_id long, x string, y string, tier string, ok boolean").coalesce(1)
    queries = spark.createDataFrame(asked, "query_id long, text string, odd int")
    split = lambda t: (t or "").replace("\u00e9", "e").split()
    # Rows of one unit count as one, but for the number of units.
    merged = {}
    for u, x, y, t, ok in rows:
        a, b, *_ = merged.get(u, ([], [], None, None))
        merged[u] = (a + split(x), b + split(y), t, ok)
    mean = sum(len(a) + len(b) for a, b, *_ in merged.values()) / len(rows)
    want = {}
    for c, name in enumerate("xy"):
        df = Counter(t for v in merged.values() for t in set(v[c]))
        for q, text, _ in asked:
            for u, v in merged.items():
                tf = Counter(v[c])
                ln = {t: math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5)) for t in split(text) if tf[t]}
                if u is not None and ln:
                    want[q, name, u] = sum((ln[t] if ln[t] > 0 else 1e-6) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * (len(v[0]) + len(v[1])) / mean)) for t in split(text) if tf[t])
    got = lambda df: {(r.query_id, r.channel, r.unit_id): round(r.score, 9) for r in df.collect()}
    near = lambda a, b: a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=2e-9) for k in a)
    monkeypatch.setattr(ranking, "CELLS", 200)
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 25)
    assert near(got(ranking.bm25(units, queries, ["x", "y"], ["x", "y"])), want) and len(want) > 500

    def best(scores, n):
        by = {}
        for (q, c, u), s in scores.items():
            by.setdefault((q, c), []).append((-round(s, 9), u))
        return {(q, c, u): -s for (q, c), v in by.items() for s, u in sorted(v)[:n]}

    out = ranking.bm25(units, queries, ["y", "x"], ["x", "y"], n=4)
    assert near(got(ranking.top(out, 4, by=("query_id", "channel"))), best(want, 4))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    # What is closed, excluded or behind a gate is gone before the limit, and still counts in the statistics.
    opened = queries.filter("odd = 1").select("query_id", F.lit("t").alias("gate"))
    gone = spark.createDataFrame([(u,) for u in range(0, 90, 11)], "unit_id long")
    some = ranking.bm25(units, queries, ["x"], ["x", "y"], F.col("ok"), 4, F.col("tier"), opened, gone)
    odd = {q for q, _, x in asked if x}
    seen = {k: s for k, s in want.items() if k[1] == "x" and k[2] % 11 and (k[2] == 3 or k[2] % 3) and (merged[k[2]][2] is None or merged[k[2]][2] == "t" and k[0] in odd)}
    assert near(got(ranking.top(some, 4)), best(seen, 4))
    assert ranking.bm25(units.limit(0), queries, ["x"], ["x"], n=4).count() == 0 and ranking.bm25(units, queries.limit(0), ["x"], ["x"], n=4).count() == 0


def test_mock_embedding_looks_at_a_text_once(spark):
    texts = ["Retry the CACHE, backoff", "no word of the list", "", None, "sqlite token auth", "\u00e9t\u00e9 " * 50]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, low string")
    out = T.mock_embedding(docs, "doc_id", "text")
    want = []
    for t in texts:
        v = [float(sum(w in (t or "").lower() for w, at in T.KEYWORDS if at == d)) for d in range(10)]
        if t is not None and not any(v):
            v = [x / 255.0 for x in hashlib.sha256(t.encode()).digest()[:10]]
        norm = math.sqrt(sum(x * x for x in v))
        want.append([x / norm if norm else 0.0 for x in v])
    assert np.allclose([r.vector for r in out.orderBy("doc_id").collect()], want, rtol=0, atol=1e-12)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert T.mock_embedding(docs.limit(0), "doc_id", "text").count() == 0


def test_repeated_spans_and_lines_are_cut_before_they_meet(spark):
    spans = spark.createDataFrame([("f", 10 * (k % 3), 10 * (k % 3) + 70, f"s{k:03}") for k in range(300)], "path string, start_line long, end_line long, breadcrumb string")
    lines = spark.createDataFrame([("f", k % 100) for k in range(500)], "path string, line long")
    out = history.align_lines(lines, spans)
    assert sorted((r.line, r.breadcrumb) for r in out.collect()) == [(k, "s000" if k <= 70 else "s001" if k <= 80 else "s002") for k in range(91)]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "min(breadcrumb" in plan and plan.index("Join Inner") < plan.index("min(breadcrumb") and plan.index("Join Inner") < plan.index("Deduplicate")


def test_texts_stay_where_they_are_for_a_short_list(spark):
    asked = spark.createDataFrame([(1, "x")], "query_id long, text string")
    rows = [(1, u, 1.0 / (u + 1), u + 1) for u in range(40)]
    fused = written(spark.createDataFrame(rows, "query_id long, unit_id long, score double, rank int"))
    pool = written(fused.select("query_id", "unit_id", F.col("rank").alias("place"), F.lit(1).alias("coverage")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        units = corpus.units(spark, SF)
        anchors = written(corpus.unit_anchors(units))
        for out, n in ((ranking.apply_priors(fused.join(asked, "query_id"), units), 40), (graph.suppress_siblings(pool, units), 1), (graph.expand(fused, anchors, units, asked), 40)):
            lines = out._jdf.queryExecution().sparkPlan().toString().splitlines()
            depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
            scans = [k for k, line in enumerate(lines) if "documents.parquet" in line]
            assert scans and out.count() >= n
            for k in scans:
                # The joins above a scan, from the nearest on: labels, then the short list.
                above, at = [], depth[k]
                for j in range(k - 1, -1, -1):
                    if depth[j] < at:
                        at = depth[j]
                        above += ["Broadcast" in lines[j]] if "Join" in lines[j] else []
                assert above[:2] == [True, True]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
