"""The driver's contract: names, schemas and SQL of the registered queries."""

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(repr(tuple(getattr(v, "item", lambda v=v: v)() for v in r)) for r in frame[columns].itertuples(index=False, name=None))


def test_entry(spark):
    got = driver.entry(spark).collect()
    assert len(got) == 5 and got[0].score >= got[-1].score


def test_sql_belongs_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", [n for n in driver.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(driver.queries()[name](spark, SF).toPandas()) == rows(con.sql(driver.oracle_sql()[name]).df())
