"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import pytest

import __spark_entry__ as contract
from lumenfit.plans.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    return sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    df = contract.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    res = con.sql(ORACLES[name])
    assert sorted(res.columns) == cols
    at = [res.columns.index(c) for c in cols]
    want = plain(tuple(r[i] for i in at) for r in res.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=1e-9, abs=1e-9) if all(isinstance(x, (int, float)) for x in g) else g == w


def test_entry(spark):
    assert contract.entry(spark).count() == 2


def test_contract_without_llm():
    """The package and its queries don't need the training-data subpackage."""
    import subprocess
    import sys

    code = "import sys; sys.modules['lumenfit.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert 'final_ols' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
