"""The queries with an SQL twin against DuckDB on a small folder."""

import os

import duckdb
import pandas as pd
import pytest

pytest.importorskip("pointloom.llm")

from pointloom.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
SQL = queries.oracle_sql()


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    one = lambda v: "~" if pd.isna(v) else format(float(v), ".9g") if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got, exp = queries.queries()[name](spark, FOLDER).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert plain(got) == plain(exp)
