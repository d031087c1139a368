"""Every query that has SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from quillon.plans import reference_oracles, reference_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, float) else str(v)

    out = df[sorted(df.columns)].map(cell)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(reference_oracles()))
def test_same_rows_as_sql(spark, sf_dir, db, name):
    got = reference_queries()[name](spark, sf_dir).toPandas()
    want = db.sql(reference_oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(canonical(got), canonical(want))
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(reference_queries()) - set(reference_oracles())))
def test_others_give_rows(spark, sf_dir, name):
    assert reference_queries()[name](spark, sf_dir).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 14 and "fabrication_rate" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
