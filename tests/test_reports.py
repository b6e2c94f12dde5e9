import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from meterline.operators import blocks as B
from meterline.operators import reports as R
from meterline.operators.filters import filter_until_day, recent_blocks
from meterline.schema import USAGE_ENTRY
from tests.test_pricing import BASE


def facts(spark, specs):
    rows = []
    for i, (ts, model, project, sid, cost) in enumerate(specs):
        d = {**BASE, "entry_id": f"e{i}", "ts": ts, "model": model, "project_path": project, "session_id": sid,
             "line_seq": i}
        rows.append(tuple(d[f.name] for f in USAGE_ENTRY.fields))
    df = spark.createDataFrame(rows, USAGE_ENTRY)
    costs = spark.createDataFrame([(f"e{i}", Decimal(str(s[4]))) for i, s in enumerate(specs)],
                                  "entry_id string, cost decimal(38,12)")
    z = F.lit(0).cast("decimal(38,12)")
    return df.join(costs, "entry_id").withColumns({"api_cost": z, "cache_create_cost": z, "cache_read_cost": z})


def test_summary_maps_skip_synthetic_and_average(spark):
    t = dt.datetime(2024, 2, 5, 10)
    df = facts(spark, [(t, "m1", "/a", "s1", 1), (t, "m1", "/b", "s1", 2), (t, "<synthetic>", "/a", "s2", 3),
                       (t, None, "/a", "s3", 0)])
    r = R.usage_summary(df).collect()[0]
    assert r.total_requests == 4 and r.total_cost == 6.0 and r.average_cost == 1.5
    assert r.models == {"m1": 2, "": 1}
    assert r.projects == {"/a": 3, "/b": 1}


def test_first_monday_weeks_differ_from_iso(spark):
    # 2021-01-01 is a Friday: the first Monday is Jan 4.  Jan 3 belongs to the week of Monday 2020-12-28,
    # week 52 when counted from 2020's first Monday (Jan 6); ISO numbering calls it 2020-W53
    s = spark.range(1).select(R.week_start_first_monday(2021, 1).alias("w")).collect()[0].w
    assert s == dt.datetime(2021, 1, 4)
    df = facts(spark, [(dt.datetime(2021, 1, 3, 12), "m", "/a", "s", 1), (dt.datetime(2021, 1, 4, 1), "m", "/a", "s", 1)])
    weeks = {(r.week_year, r.week) for r in R.weekly_report_all(df).collect()}
    assert weeks == {(2020, 52), (2021, 1)}
    from meterline.functions.timefns import iso_week_key
    assert df.select(iso_week_key("ts").alias("k")).distinct().orderBy("k").collect()[0].k == "2020-W53"
    assert R.weekly_report(df, 2021, 1).collect()[0].total_requests == 1


def test_period_report_bounds(spark):
    df = facts(spark, [(dt.datetime(2024, 2, 29, 23, 59), "m", "/a", "s", 1),
                       (dt.datetime(2024, 3, 1, 0, 0), "m", "/a", "s", 1)])
    day = R.period_report(df, "daily", "2024-03-01").collect()[0]
    assert (day.total_requests, day.end_time) == (1, dt.datetime(2024, 3, 2))
    month = R.period_report(df, "monthly", "2024-02").collect()[0]
    assert (month.total_requests, month.end_time) == (1, dt.datetime(2024, 3, 1))


def test_until_day_and_recent_blocks(spark):
    df = facts(spark, [(dt.datetime(2024, 1, d, 12), "m", "/a", "s", 1) for d in (1, 5, 9)])
    assert filter_until_day(df, "2024-01-05", "2024-01-05", "2024-02-01").count() == 1
    assert filter_until_day(df, "bad", None, "2024-01-06 00:00:00").count() == 2      # open start, until = as_of
    blocks = B.identify_blocks(df, as_of="2024-01-10 00:00:00")
    assert recent_blocks(blocks, "2024-01-10 00:00:00", 3).count() == 1


def test_daily_total_row_recounts_sessions(spark):
    t = dt.datetime(2024, 4, 1, 8)
    df = facts(spark, [(t, "m", "/a", "s1", 1), (t + dt.timedelta(days=1), "m", "/a", "s1", 1),
                       (t + dt.timedelta(days=1), "m", "/a", "s2", 1)])
    rows = {(r.date_key, r.is_total): r.sessions for r in R.daily_report(df, with_total=True).collect()}
    assert rows == {("2024-04-01", False): 1, ("2024-04-02", False): 2, (None, True): 2}


def test_current_block_tie_breaks_on_key(spark):
    t = dt.datetime(2024, 4, 1, 8, 10)
    df = facts(spark, [(t, "m", "/a", "b-user", 1), (t, "m", "/a", "a-user", 1)])
    blocks = B.identify_blocks(df, key="session_id", as_of=t + dt.timedelta(hours=1))
    assert B.current_block(blocks, "session_id").collect()[0].session_id == "a-user"
