"""The pipeline against brute force, stage by stage."""

import duckdb
import sentencepiece

import corpus_pipeline
from lodestone.llm import pii, quality, sentencepieces
from tests.llm.test_neardup import brute
from tests.llm.test_single_pass import brute_hits
from tests.llm.util import corpus, frame, table


def test_pipeline(spark, tmp_path):
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    # No eight words of it repeat, and the changed word leaves other five-word shingles.
    long = " ".join(f"Word{k} thing{'.' if k % 9 == 8 else ''}" for k in range(60)) + "."
    docs = [(i, t) for i, t in corpus() if i is not None][:-2]
    docs += [(5001, long), (5002, long + " Ok."), (5003, long.replace("thing", "word") + " " + items[0][1]), (5004, long.replace("thing", "fact") + " Mail x@y.com.")]
    frame(spark, docs, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = [(r.doc_id, r.text) for r in quality.filter_documents(frame(spark, docs, extra=False)).collect()]
    one = {d for d, _, _, kept in brute(clean, 5) if kept}
    left = [(d, t) for d, t in clean if d in one]
    left = [x for x, hit in zip(left, brute_hits(left, items), strict=True) if not hit[-1]]
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    want = {d: lib.encode(pii.masked(t)) for d, t in left}
    assert {d: r.ids for d, r in got.items()} == want
    assert 5001 in got and not {5002, 5003} & set(got)
    assert "[EMAIL]" in lib.decode(got[5004].ids)


def test_every_stage_but_the_last_keeps_the_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert [(c, t) for c, t in out.dtypes] == docs.dtypes
            docs = out
    assert duckdb.sql(f"select count(*) from '{d}/documents.parquet'").fetchall()[0][0] > out.count() > 0


def test_empty_and_odd_tables(spark, tmp_path):
    text = " ".join(f"Word{k} thing{'.' if k % 9 == 8 else ''}" for k in range(60)) + "."
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, text + " More."), (5, text.replace("thing", "fact"))]
    cases = {"none": [], "odd": rows}
    for name, docs in cases.items():
        d = f"{tmp_path}/{name}"
        df = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, ids string, `row` int")
        df.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.columns == ["doc_id", "lang", "source", "n_chars", "row", "ids", "round_trip"]
        got = sorted(str(r.doc_id) for r in out.collect())
        assert got == ([] if name == "none" else ["1", "5", "None"])
        assert all(r.round_trip and r.row == 2 and r.n_chars > 100 for r in out.collect())
