"""Every registered query of the library against its SQL in DuckDB, over the smallest tables."""

import duckdb
import numpy as np
import pytest

from noctua.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or df[c].dtype == bool or "datetime" in str(df[c].dtype):
            df[c] = df[c].map(lambda v: "" if v is None or v != v else str(list(v)) if isinstance(v, np.ndarray) else str(v))
        else:
            df[c] = df[c].astype(float).round(9).fillna(-9e99) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    rows = duck.sql(ORACLE_SQL[name])
    want = rows.df()
    for c, kind in zip(rows.columns, rows.types, strict=True):
        if str(kind) == "DATE":  # which df() turns into timestamps
            want[c] = want[c].map(lambda v: None if v != v else v.date())
    got, want = plain(QUERIES[name](spark, DATA).toPandas()), plain(want)
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        assert got[c].tolist() == want[c].tolist(), c
