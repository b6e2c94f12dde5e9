"""A representative subset of the registered queries against their DuckDB
oracle on the smallest table set (the full set runs in the driver's check)."""

import sys

import pytest

import __spark_entry__ as E
from meterline.plans.check import compare, duck_connect
from tests.conftest import SF_SMALL

SUBSET = ["daily_report", "daily_report_total", "monthly_report", "session_report", "source_file_report",
          "block_type_report", "period_summary", "weekly_report_all", "price_resolution", "session_names",
          "block_report", "block_report_global", "block_assignment", "block_limit_status", "usage_stats",
          "usage_trend", "gap_sessions", "entries_csv", "jsonl_ingest", "jsonl_rejects"]


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, duck, name):
    ok, n, _, detail = compare(spark, duck, SF_SMALL, name, E.queries()[name], E.oracle_sql()[name])
    assert ok, detail


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "date_key"


def test_every_reference_query_has_an_oracle():
    from meterline.plans.queries import QUERIES
    qs, oracle = E.queries(), E.oracle_sql()
    assert set(QUERIES) <= set(qs) and set(QUERIES) <= set(oracle) and set(oracle) <= set(qs)


def test_entry_works_without_the_optional_operators():
    code = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("meterline.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as E
from meterline.plans.queries import QUERIES
assert set(E.queries()) == set(QUERIES) == set(E.oracle_sql())
"""
    import os
    import subprocess
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)

def test_entry_sets_the_session_options_it_needs(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = E.entry(spark).select("date_key").collect()
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
        assert rows[0].date_key.startswith("2024-01")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
