"""Every named query against its SQL on the smallest tables."""

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def shown(row):
    return tuple(repr(v) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    if name not in contract.oracle_sql():
        pytest.skip("no SQL; tested against a brute-force version")
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(shown(r) for r in df.select(*columns).collect())
    assert got == sorted(shown(r) for r in result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).columns == ["Type", "Value", "Row_Positions", "Count", "Part"]
    assert contract.entry(spark).count() > 0
