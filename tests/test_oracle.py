"""Every query that has SQL returns the rows that DuckDB returns."""

import duckdb
import pandas as pd
import pytest

from chronoloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got, want = registry.queries()[name](spark, DIR).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0
    assert normal(got.astype(object)) == normal(want.astype(object))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0
