"""Every query with an oracle against DuckDB, on the smallest tables."""

import os

import pytest

from quernstone.plans import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted([plain(v) for v in r] for r in got.select(*columns).collect())
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert rows == sorted([plain(v) for v in r] for r in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
