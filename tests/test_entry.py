"""Every query with SQL against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the synthetic tables are not here")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    flat = lambda row: repr([round(x, 5) if isinstance(x, float) else x for x in row])
    got = sorted(flat([r[c] for c in cols]) for r in df.collect())
    z = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in z.description]
    assert sorted(names) == cols and got == sorted(flat([r[names.index(c)] for c in cols]) for r in z.fetchall())
