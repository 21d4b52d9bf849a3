"""Corpus queries that SQL can state, against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from peakloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(name, spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf).toPandas()[list(want.columns)]
    got, want = (x.sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and (got == want).all().all()
