"""Registered corpus queries give the rows of their SQL over whole tables."""

import duckdb
import pytest

from lodestone.llm import oracles, queries
from tests.llm.util import SF
from tests.test_queries import TABLES, canonical


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(oracles.oracle_sql()[name])
    names = [c[0] for c in want.description]
    found = canonical(got.columns, [tuple(r) for r in got.collect()])
    assert found == canonical(names, want.fetchall())
    assert len(found[1]) > 0
