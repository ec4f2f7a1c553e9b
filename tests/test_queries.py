"""Every registered query of the engine against its SQL in DuckDB, and the contract of the entry module."""

from __future__ import annotations

import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from colophon.plans import catalogue
from tests.conftest import SF

REPO = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, list):
        return tuple(map(plain, value))
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[i]) for i in places) for r in found.fetchall())


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0


@pytest.mark.parametrize("leave_folder", [False, True])
def test_entry_imports_without_the_optional_folders(tmp_path, leave_folder):
    for part in ("colophon", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", REPO / part, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "colophon" / "llm"], check=True)
    if leave_folder:
        (tmp_path / "colophon" / "llm").mkdir()
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
