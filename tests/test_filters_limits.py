import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterline.operators.filters import filter_days, filter_session_id, filter_session_name, normalize_day
from meterline.sources.limits import limit_status, limits_from_json


@pytest.fixture()
def sessions(spark):
    return spark.createDataFrame([("1", "s1", "alpha"), ("2", "s2", ""), ("3", "s1", "alpha")],
                                 "id string, session_id string, session_name string")


def test_session_filters(sessions):
    assert filter_session_id(sessions, "s1").count() == 2
    assert filter_session_name(sessions, "alpha").count() == 2
    assert filter_session_name(sessions, "nope").count() == 0
    assert filter_session_name(sessions, "").count() == 3


def test_day_forms(spark):
    assert normalize_day("20240105") == "2024-01-05" == normalize_day("2024-01-05")
    with pytest.raises(ValueError):
        normalize_day("2024-1-5")
    df = spark.createDataFrame([("2024-01-04",), ("2024-01-05",), ("2024-01-20",), ("2024-01-21",)], "date_key string")
    assert filter_days(df, "20240105", "2024-01-20").count() == 2


# fixed values: a snapshot with one null tier
SNAPSHOT = ('{"five_hour": {"utilization": 5.0, "resets_at": "2026-03-11T18:00:00+00:00"},'
            '"seven_day": {"utilization": 95.0, "resets_at": "2026-03-13T02:00:00+00:00"},'
            '"seven_day_sonnet": {"utilization": 61.0, "resets_at": "2026-03-13T19:30:00+00:00"},'
            '"seven_day_opus": null}')


def test_limits_and_levels(spark):
    docs = spark.createDataFrame([(SNAPSHOT,)], "value string")
    rows = {r.tier: r for r in limit_status(limits_from_json(docs), "UTC", "2026-03-11 12:00:00").collect()}
    assert set(rows) == {"five_hour", "seven_day", "seven_day_sonnet"}
    assert [rows[t].level for t in ("five_hour", "seven_day_sonnet", "seven_day")] == ["green", "yellow", "red"]
    assert rows["five_hour"].reset_label == "Resets 6pm (UTC)"
    assert rows["seven_day_sonnet"].reset_label == "Resets Mar 13 at 7:30pm (UTC)"


def test_filter_day_in_zone(spark):
    from meterline.operators.filters import filter_day
    rows = [(dt.datetime(2024, 3, 10, 4, 59),), (dt.datetime(2024, 3, 10, 5, 0),), (dt.datetime(2024, 3, 11, 3, 59),),
            (dt.datetime(2024, 3, 11, 4, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp")
    # 2024-03-10 in New York: 05:00 UTC to 04:00 UTC next day (the clocks change that night)
    got = sorted(r.ts for r in filter_day(df, "20240310", "America/New_York").collect())
    assert got == [dt.datetime(2024, 3, 10, 5, 0), dt.datetime(2024, 3, 11, 3, 59)]


def test_removed_projects(spark):
    from meterline.streaming.refresh import removed_projects
    t = dt.datetime(2024, 1, 1)
    schema = "path string, modification_time timestamp, length long"
    old = spark.createDataFrame([("/r/projects/a/1.jsonl", t, 1), ("/r/projects/b/2.jsonl", t, 1)], schema)
    new = spark.createDataFrame([("/r/projects/a/1.jsonl", t, 1)], schema)
    assert [r.project for r in removed_projects(old, new).collect()] == ["b"]
