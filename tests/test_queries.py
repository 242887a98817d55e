"""Every general query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from parafold.plans import filter_queries, robust_queries, sensing_queries  # noqa: F401
from parafold.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "documents conversations events embeddings nation orders".split()


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x
    return sorted(repr([clean(r[i]) for i in order]) for r in records), sorted(columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    got = QUERIES[name](spark, DIR)
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), [c[0] for c in want.description])
