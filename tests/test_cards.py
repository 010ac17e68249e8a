"""Cards of customers without orders against the query's SQL."""

import datetime

import pytest

from quernstone.plans import catalog, contract_queries  # noqa: F401

duckdb = pytest.importorskip("duckdb")


def test_customer_without_orders(spark, tmp_path):
    customers = [(n, 500.0 * n - 600, s) for n, s in enumerate(("BUILDING", "HOUSEHOLD", "MACHINERY", "FURNITURE", "MACHINERY"))]
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(9, 4, "P", 460000.0, datetime.datetime(2024, 1, 2), "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(f"SELECT c_custkey, errors FROM ({catalog.ORACLE_SQL['q_card_errors']})").fetchall()
    got = catalog.QUERIES["q_card_errors"](spark, str(tmp_path)).select("c_custkey", "errors").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any("loss_evidence: minItems" in e for _, e in want)
