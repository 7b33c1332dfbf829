"""The registered catalogue: names, oracles, and a few queries end to end."""

import importlib

import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("inflow_new_payers_firings", "merchant_alerts", "roc_auc_scored_docs", "registry_findings", "stream_merchant_alerts", "port_numbers")


def test_every_oracle_belongs_to_a_query():
    e = importlib.import_module("__spark_entry__")
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(o) > 150


def test_flagship(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, sf, name):
    from check import norm

    e = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert norm(e.queries()[name](spark, sf).toPandas()) == norm(con.execute(e.oracle_sql()[name]).df())
