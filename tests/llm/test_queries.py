import duckdb
import pytest

import __spark_entry__ as E
from toposcope.llm.queries import QUERIES
from toposcope.llm.sql import SQL

SF = "/root/testdata/sf0.01"


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(map(repr, cur.fetchall()))
    got = sorted(repr(tuple(r)) for r in df.select(cols).collect())
    assert got == want
