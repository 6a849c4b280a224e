import pytest

import __spark_entry__ as entry
from gridloom import queries


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(map(repr, frame.values.tolist()))


def test_names_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    found = entry.entry(spark)
    assert found.columns == ["id", "x"] and found.count() == 200


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("part", "lineitem", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want, got = con.sql(queries.SQL[name]).df(), queries.QUERIES[name](spark, sf_dir).toPandas()
    number = lambda f: f.astype({c: "float64" for c in f.columns if f[c].dtype.kind in "iuf"}).round(9)
    assert rows(number(got)) == rows(number(want))
