"""Every SQL of the corpus operators in DuckDB against its query, with all columns."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from colophon.llm import queries
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    out = queries.queries()[name](spark, SF)
    columns = sorted(out.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert Counter(tuple(r[names.index(c)] for c in columns) for r in found.fetchall()) == Counter(tuple(r[c] for c in columns) for r in out.collect())
