"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomtext import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def rows(df):
    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        return round(float(v), 9) + 0.0 if isinstance(v, (float, np.floating, int, np.integer)) and not isinstance(v, (bool, np.bool_)) else str(v)

    df = df[sorted(df.columns)]
    return sorted(map(repr, (tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_its_sql(spark, con, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = con.sql(catalog.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_run(spark):
    assert catalog.queries()["run_stats_append"](spark, DATA).count() == 2
    got = catalog.queries()["align_segments"](spark, DATA).toPandas()
    for _, one in got.sort_values("segment").groupby(["digest_id", "source_id"]):
        ends = [0, *one["digest_end"]]
        assert list(one["digest_start"]) == ends[:-1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["item_id", "doc_id", "matching", "total", "containment", "extent"]
