"""Registered queries of the package against their SQL twins; the package's place in the library."""

import importlib
import pathlib
import sys

import duckdb
import pytest

from queries.check import compare, connect
from tabulens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, name):
    assert compare(spark, connect(data), QUERIES[name], ORACLES[name], data) is None


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_source_mixing", "op7_quality_rules", "op8_line_dedup", "op13_fill_in_middle"])
def test_query_matches_sql_on_awkward_rows(spark, awkward, tmp_path, name):
    rows = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, con, QUERIES[name], ORACLES[name], str(tmp_path)) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_nothing_else_imports_the_package():
    root = pathlib.Path(__file__).parents[2]
    for path in [*root.glob("tabulens/**/*.py"), *root.glob("queries/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "tabulens.llm" not in path.read_text(), path


def test_entry_lists_the_queries(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert "tabulens.llm" in sys.modules
