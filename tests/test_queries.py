"""Every registered spectra query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from peakloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(name, spark, sf, duck):
    got = registry.queries()[name](spark, sf).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        a, b = got[c], want[c]
        if a.dtype.kind in "fiub" and b.dtype.kind in "fiub":
            np.testing.assert_array_equal(a.to_numpy(float, na_value=np.nan), b.to_numpy(float, na_value=np.nan), err_msg=c)
        else:
            assert (a.astype(str) == b.astype(str)).all(), c


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["spectrum_id", "time", "mz", "intensity"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
