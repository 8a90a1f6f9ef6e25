"""Every query that SQL can express, against DuckDB on the same tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from loomgraph.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    def norm(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted(tuple(norm(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
