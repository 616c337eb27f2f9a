"""Every registered query with SQL gives the SQL's rows."""

import math

import duckdb
import pytest

from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    found = canonical(got.columns, [tuple(r) for r in got.collect()])
    want = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert found == canonical(names, want.fetchall())
    assert len(found[1]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
