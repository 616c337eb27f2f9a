"""Small corpora and brute-force helpers."""

import re

import duckdb

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

NASTY = [
    "", None, " ", "\n\n", "a", "a b", "a  b\n", "x" * 5000, "word " * 300, "é" * 1000, "▁ mark ▁▁x", "  lead and trail  ",
    "mail a.b@c.d.e@f.g and x@y and @z.w  +1 (23) 45-67 89 0  1.2.3.4.5.6.7.8 256.1.1.1 4539 1488-0343 6467 0004539148803436467",
    "IBAN GB82 WEST 1234 5698 7654 32 ok; ssn 123-45-6789; 123-45-6789 far", "tab\tsep\x0bvt\x0cff\rcr", "日本語 テキスト 🎉 emoji\u00a0nbsp",
    "1" * 4000 + "." + "2" * 4000, "+1" * 500, "- " * 200, "Home | About | Contact | Login\n" * 30,
]


def table(name):
    cols = duckdb.sql(f"describe select * from '{SF}/{name}.parquet'").fetchall()
    names = [c[0] for c in cols]
    return [dict(zip(names, r, strict=True)) for r in duckdb.sql(f"select * from '{SF}/{name}.parquet'").fetchall()]


def corpus():
    """(doc_id, text) of the smallest table, nasty texts, and repeated rows."""
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    rows += [(100_000 + i, t) for i, t in enumerate(NASTY)]
    return [*rows, rows[0], rows[0], (None, rows[1][1]), (None, None)]


def frame(spark, rows, extra=True):
    """A documents table over several partitions, with extra columns whose names clash with inner ones."""
    kind = DOCS + (", row string, key string, `hits` int, `_words` int" if extra else "")
    tail = ("r", "k", 1, 2) if extra else ()
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, *tail) for i, t in rows], kind).repartition(4)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")
