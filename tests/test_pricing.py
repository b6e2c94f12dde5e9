from decimal import Decimal

from pyspark.sql import functions as F

from meterline.operators.pricing import resolve_prices, with_cost
from meterline.schema import PRICE_TABLE, USAGE_ENTRY

BASE = dict(entry_id="e", ts=None, project_path="/p", model="claude-sonnet-4-5-20250514", input_tokens=100,
            output_tokens=50, cache_create_tokens=200, cache_read_tokens=500, total_tokens=850,
            logged_cost=Decimal(0), session_id="s", block_type=None, message_id=None, request_id=None,
            usage_limit_reset_time=None, source_file="/f.jsonl", file_first_ts=None, file_block_start=0, line_seq=0)


def rows(spark, *dicts):
    return spark.createDataFrame([tuple({**BASE, **d}[f.name] for f in USAGE_ENTRY.fields) for d in dicts],
                                 USAGE_ENTRY)


def test_cost_split(spark):
    # fixed values: mock prices 0.01 / 0.03 / 0.005 / 0.001 -> 2.5 + 1.0 + 0.5 = 4.0
    prices = spark.createDataFrame([("claude-sonnet-4-5-20250514", Decimal("0.01"), Decimal("0.03"),
                                     Decimal("0.005"), Decimal("0.001"))], PRICE_TABLE)
    r = with_cost(rows(spark, {}), prices).collect()[0]
    assert (r.api_cost, r.cache_create_cost, r.cache_read_cost, r.cost) == (
        Decimal("2.5"), Decimal("1.0"), Decimal("0.5"), Decimal("4.0"))


def test_logged_cost_wins_and_split_stays_zero(spark):
    r = with_cost(rows(spark, {"logged_cost": Decimal("1.25")})).collect()[0]
    assert r.cost == Decimal("1.25") and r.api_cost == 0 and r.cache_create_cost == 0


def test_missing_cache_tokens_cost_nothing(spark):
    r = with_cost(rows(spark, {"cache_create_tokens": None, "cache_read_tokens": None})).collect()[0]
    assert r.cache_create_cost == 0 and r.cache_read_cost == 0 and r.cost == r.api_cost


def test_price_variants_and_default(spark):
    models = ["claude-3-5-sonnet-20241022", "sonnet-20241022", "3-haiku-20240307", "claude-3-opus",
              "gpt-4o", "nothing-like-it", None]
    df = rows(spark, *[{"model": m} for m in models])
    got = {r.model: (r.price_source, r.input_cost_per_token) for r in resolve_prices(df).collect()}
    assert got["claude-3-5-sonnet-20241022"] == ("embedded", Decimal("0.000003"))
    assert got["sonnet-20241022"] == ("embedded", Decimal("0.000003"))
    assert got["3-haiku-20240307"] == ("embedded", Decimal("0.00000025"))
    assert got["claude-3-opus"] == ("embedded", Decimal("0.000015"))
    assert got["nothing-like-it"] == ("default", Decimal("0.000001"))
    assert got[None] == ("default", Decimal("0.000001"))


def test_user_table_exact_match_first(spark):
    prices = spark.createDataFrame([("gpt-4o", Decimal("1"), Decimal("2"), Decimal("3"), Decimal("4"))], PRICE_TABLE)
    got = {r.model: r.price_source for r in resolve_prices(rows(spark, {"model": "gpt-4o"}, {"model": "gpt-4"}),
                                                          prices).collect()}
    assert got == {"gpt-4o": "table", "gpt-4": "embedded"}


def test_pricing_never_shuffles_the_facts(spark):
    plan = with_cost(rows(spark, {})).select("cost")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
