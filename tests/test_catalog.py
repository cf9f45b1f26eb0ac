"""Each query against its SQL twin on the smallest tables, and plans."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__
from ledgerlark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    mine = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    assert mine == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 16
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(catalog.queries()["alert_feed"](spark, SF))
    assert "GreaterThanOrEqual(l_discount,0.08)" in p and "GreaterThanOrEqual(l_shipdate" in p and "TakeOrderedAndProject" in p
    p = plan(catalog.queries()["latest_per_key"](spark, SF))
    assert "props" not in p


def test_no_python_in_batch_plans(spark):
    for name in ("rules_scored", "batch_card_features", "spend_deciles", "rule_effectiveness", "dq_valid"):
        assert "Python" not in plan(catalog.queries()[name](spark, SF)) and "Arrow" not in plan(catalog.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["dq_reason_counts", "dq_valid", "stream_intake"])
def test_values_of_0_equal_sql(spark, tmp_path, name):
    """As sf0.1 has them: among valid payloads, and beside each defect."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CASE WHEN event_id < 50 THEN 0 ELSE value END AS value) FROM '{SF}/events.parquet'")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*names).collect()) == sorted(tuple(plain(v) for v in r) for r in found.fetchall())
