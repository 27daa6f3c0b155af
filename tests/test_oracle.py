import pytest

from tests.oracle import compare, connect
from workload import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        same, note = compare(df, duck, ORACLES[name])
        assert same, note
    else:
        assert df.count() > 0


def test_entry_reports_both_stages(spark):
    import __spark_entry__ as entry

    assert {r["stage"] for r in entry.entry(spark).collect()} == {"retrieved", "reranked"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_python_workers_find_the_package(tmp_path):
    """A fresh process in another folder, as a driver program would be."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.append({root!r})
from pyspark.sql import SparkSession
from workload import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", QUERIES["knn"](spark, {FOLDER!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows 10000" in done.stdout, done.stderr[-2000:]
