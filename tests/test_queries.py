"""Every query with SQL against DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__
import metaloom.queries_agents  # noqa: F401
import metaloom.queries_census  # noqa: F401
import metaloom.queries_relational  # noqa: F401
import metaloom.queries_sources  # noqa: F401
from metaloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda x: "null" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x).lower()
    return sorted(tuple(text(r[i]).replace("-0.000000", "0.000000") for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name in SQL:
        out = con.execute(SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows_of(names, out.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
