"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from wovenkb.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([_plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    told = duck.execute(SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.collect(), df.columns) == _rows(told.fetchall(), columns)


@pytest.mark.parametrize("name", ["search_end_to_end", "c8_c10_split_documents", "w5_w10_c12_c18_tables", "d27_markdown_tables", "j10_many_queries"])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
