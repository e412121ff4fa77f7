import duckdb
import pytest

from tidemark import catalogue

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, name):
    df = catalogue.queries()[name](spark, D)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for table in ("events", "supplier", "region"):
        con.sql(f"create view {table} as select * from '{D}/{table}.parquet'")
    sql = con.sql(catalogue.oracle_sql()[name])
    assert columns == sorted(sql.columns)
    want = sorted(sql.select(*[f'"{c}"' for c in columns]).fetchall(), key=repr)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == want


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
