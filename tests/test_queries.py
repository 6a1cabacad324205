"""Every registered query against its SQL twin on the shared tables."""

import shutil
import subprocess
import sys

import oracle
import pytest
from conftest import ROOT, SF_DIR

import __spark_entry__ as driver

# Queries on text corpora are tested in tests/llm.
QUERIES = driver.table_queries()
TWINS = {name: sql for name, sql in driver.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return oracle.open_duckdb(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns, expected = oracle.duckdb_bag(duck, TWINS[name])
    assert sorted(frame.columns) == sorted(columns)
    assert sum(expected.values()) > 0
    assert oracle.spark_bag(frame) == expected


def test_entry_has_rows(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["cust_id", "tier", "num_orders", "sales_total"]
    assert frame.count() > 0


@pytest.mark.parametrize("gone", [(), ("tablemill/llm", "tests/llm"), ("tablemill/llm", "tests/llm", "corpus_pipeline.py")])
def test_imports_without_the_text_operators(tmp_path, gone):
    """The text operators and their pipeline may be deleted, together or not."""
    leave = shutil.ignore_patterns(".git", "__pycache__", *(path.split("/")[-1] for path in gone))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=leave)
    code = "import __spark_entry__ as d; print(len(d.queries()) - len(d.table_queries()), len(d.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    more, twins = map(int, done.stdout.split())
    there = bool(gone) or not (ROOT / "tablemill" / "llm").exists()
    assert (more == 0) == there and twins >= len(driver.table_queries())
