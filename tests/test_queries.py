"""Every query with SQL against DuckDB, and the registry."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, db, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-9)


def test_registry_needs_no_jar_and_no_session():
    code = "import pyspark, os; pyspark.__file__ = '/nowhere/pyspark/__init__.py'; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(s) <= set(q); print(len(q), len(s))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_a_module_that_cannot_be_imported_costs_its_own_queries_only(monkeypatch):
    monkeypatch.setitem(sys.modules, "textloom.llm.bpe", None)
    left = entry.queries()
    assert "op4_bpe" not in left and "whitespace_tokens" in left
