"""The driver contract, and a sample of the SQL twins at the smallest scale."""

import importlib.util
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("verify", ROOT / "tools" / "verify.py")
verify = importlib.util.module_from_spec(spec)
spec.loader.exec_module(verify)

SAMPLE = ("a03_daily_by_model", "a10_tools_by_share", "a22_heat_levels", "a25_area_series", "i14_report", "j06_skill_names", "j08_quota_carry",
          "q06_reset_credits", "s05_skill_counters", "t01_counter_deltas", "t06_fork_dedup", "t09_turn_pairs", "b03_next_runs")


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 4


def test_every_query_has_a_twin():
    """All but those of the optional training-data operators that SQL cannot express."""
    assert not {key for key in set(entry.queries()) - set(entry.oracle_sql()) if key not in entry.EXTRA_QUERIES}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in verify.TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("key", SAMPLE)
def test_twin(spark, con, key):
    error, _ = verify.compare(key, entry.queries()[key](spark, SF), entry.oracle_sql()[key], con)
    assert error is None


def test_runs_in_a_session_built_elsewhere(tmp_path):
    """No setting of ours at start, another working directory, the package not installed."""
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() == 4
assert e.queries()["t01_counter_deltas"](spark, {SF!r}).count() > 0
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
