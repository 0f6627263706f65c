import duckdb
import pytest

import __spark_entry__ as entry
from glossweave.plans import queries

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("part", "documents", "pages", "embeddings", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    order = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert order(tuple(r[c] for c in columns) for r in got.collect()) == order(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
