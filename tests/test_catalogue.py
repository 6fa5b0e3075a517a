import math

import duckdb
import pytest

import __spark_entry__
from lexivane.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if x is None or isinstance(x, float) and math.isnan(x) else repr(round(float(x), 9)) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE_SQL:
        want = duck.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got.toPandas()) == values(want)
    else:
        assert got.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_tables_keep_large_ids_apart(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table benchmark as select 7::bigint item_id, 'thion erthing reen' as text")
    con.execute("create table conversations as select 17179869::bigint conv_id, 189::bigint turn, 'user' as role, 'onthe thation' as text")
    con.execute("create table documents as select 5::bigint doc_id, 'thion x' as text union all select 6, 'erthing onthe thion'")
    for t in ("benchmark", "conversations", "documents"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    got = catalogue.QUERIES["search_all_tables"](spark, str(tmp_path)).toPandas()
    assert values(got) == values(con.execute(catalogue.ORACLE_SQL["search_all_tables"]).df())
