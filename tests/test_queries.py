"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, comparable


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == comparable(names, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_tables_are_read(spark, sf_dir):
    queries, count = entry.queries(), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert queries["last_fold_scores_all"](spark, sf_dir).count() == orders
    scored = queries["lr_scores"](spark, sf_dir).collect()
    assert len(scored) == count("documents") > sum(r.y is not None for r in scored) > 0
    assert all(0 <= r.score <= 1 for r in scored)
    assert queries["document_roc"](spark, sf_dir).count() == 1
