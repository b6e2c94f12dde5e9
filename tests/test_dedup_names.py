import datetime as dt
from decimal import Decimal

from meterline.operators.dedup import dedup_usage, merge_projects
from meterline.operators.names import session_names, with_session_name
from meterline.schema import NAME_ROW, USAGE_ENTRY
from tests.test_pricing import BASE

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def entries(spark, specs):
    out = []
    for i, (mid, rid, f, ft, seq) in enumerate(specs):
        d = {**BASE, "entry_id": f"e{i}", "message_id": mid, "request_id": rid, "source_file": f,
             "file_first_ts": ft, "line_seq": seq, "input_tokens": i}
        out.append(tuple(d[x.name] for x in USAGE_ENTRY.fields))
    return spark.createDataFrame(out, USAGE_ENTRY)


def test_keep_first_in_load_order(spark):
    later, earlier = T0, T0 - dt.timedelta(days=1)
    df = entries(spark, [("m1", "r1", "/b.jsonl", later, 0),     # e0: later file
                         ("m1", "r1", "/a.jsonl", earlier, 5),   # e1: earlier file -> kept
                         ("m1", "r1", "/a.jsonl", earlier, 9),   # e2
                         ("m2", None, "/a.jsonl", earlier, 1),   # un-keyed: kept
                         ("m2", None, "/a.jsonl", earlier, 2),   # un-keyed: kept
                         ("m3", "", "/c.jsonl", None, 0)])       # empty key = missing: kept
    got = sorted(r.entry_id for r in dedup_usage(df).collect())
    assert got == ["e1", "e3", "e4", "e5"]


def test_files_without_time_go_last(spark):
    df = entries(spark, [("m", "r", "/a.jsonl", None, 0), ("m", "r", "/z.jsonl", T0, 0)])
    assert [r.entry_id for r in dedup_usage(df).collect()] == ["e1"]


def test_hot_key_third_of_rows(spark):
    specs = [("hot", "r", f"/f{i % 7}.jsonl", T0 + dt.timedelta(seconds=i % 7), i) for i in range(300)]
    specs += [(f"m{i}", "r", "/g.jsonl", T0, i) for i in range(600)]
    assert dedup_usage(entries(spark, specs)).count() == 601


def test_merge_projects_keeps_unkeyed(spark):
    a = entries(spark, [("m", "r", "/a", T0, 0)])
    b = a.withColumn("session_id", a.session_id)
    out = merge_projects([a, b])
    assert out.count() == 1


def names(spark, rows):
    return spark.createDataFrame(rows, NAME_ROW)


def test_title_beats_agent_inside_a_file_last_title_wins(spark):
    rows = [("s1", "agent", "agent-a", "/f1", T0, 0, 1), ("s1", "title", "t1", "/f1", T0, 0, 2),
            ("s1", "title", "t2", "/f1", T0, 0, 3), ("s1", "agent", "agent-b", "/f1", T0, 0, 4),
            ("s2", "agent", "first-agent", "/f1", T0, 0, 5), ("s2", "agent", "second-agent", "/f1", T0, 0, 6)]
    got = {r.session_id: r.session_name for r in session_names(names(spark, rows)).collect()}
    assert got == {"s1": "t2", "s2": "first-agent"}


def test_first_file_in_load_order_wins_across_files(spark):
    rows = [("s1", "title", "late-title", "/b", T0, 0, 1),
            ("s1", "agent", "early-agent", "/a", T0 - dt.timedelta(hours=1), 0, 1)]
    got = {r.session_id: r.session_name for r in session_names(names(spark, rows)).collect()}
    assert got == {"s1": "early-agent"}


def test_backfill_reaches_entries_of_other_files(spark):
    df = entries(spark, [("m", "r", "/other.jsonl", T0, 0)])
    n = spark.createDataFrame([("s", "named")], "session_id string, session_name string")
    assert with_session_name(df, n).collect()[0].session_name == "named"
