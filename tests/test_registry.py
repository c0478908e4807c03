"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame):
    out = []
    for r in frame.itertuples(index=False, name=None):
        out.append(tuple("null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(k for k in SQL if not k.startswith("op")))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(SQL[name]).df()
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got[columns]) == rows(want[columns])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
