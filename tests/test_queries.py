"""Every registered query against its SQL statement on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
SF_DIR = "/root/testdata/sf0.001"


def load(path, name):
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


ENTRY = load(ROOT / "__spark_entry__.py", "entry")
CHECK = load(ROOT / "tools" / "check.py", "check")
QUERIES, STATEMENTS = ENTRY.queries(), ENTRY.oracle_sql()
#: Minutes each, for their number of columns or rounds; tools/check.py compares them.
SLOW = {"psi_5_wide_sweep", "mdl_8_sweep_adds_up", "mdl_17_baseline_job"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in sorted(Path(SF_DIR).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(STATEMENTS) - SLOW))
def test_query_matches_sql(spark, duck, name):
    got = CHECK.normalise(QUERIES[name](spark, SF_DIR).toPandas())
    want = CHECK.normalise(duck.execute(STATEMENTS[name]).df())
    assert got == want


def test_entry(spark):
    assert ENTRY.entry(spark).count() == 7
