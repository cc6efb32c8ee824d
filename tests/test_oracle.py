"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from canopy.plans import learning, registry, relational, statistics  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype
        if str(kind).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif kind == object:
            df[c] = df[c].map(lambda x: None if x is None or x != x else str(x))
        elif kind.kind in "iub":
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, db, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), db.sql(registry.ORACLE[name]).df()
    pd.testing.assert_frame_equal(canonical(got), canonical(want), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
