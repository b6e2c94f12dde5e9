"""Live reports by deltas equal the batch reports and cost the new lines."""

import os
import random

from pyspark.sql import functions as F

from meterline.operators import reports as R
from meterline.operators.partials import (SCHEMA, daily_from_partials, day_partials, merge_partials, monthly_from_partials,
                                          totals_from_partials)
from meterline.sources.jsonl import load_usage
from meterline.streaming.runs import FANOUT, RunLog
from meterline.streaming.stateful import LiveLog
from tests.test_jsonl import usage, write
from tests.test_live_state import logs


def same(a, b):
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


def batch_activity(e):
    return e.groupBy("session_id", F.session_window("ts", "5 hours").alias("w")).agg(
        F.count(F.lit(1)).alias("entries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(
        "session_id", F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "entries", "first_ts", "last_ts")


def check_all(spark, root, live):
    e = load_usage(spark, root)["entries"]
    same(live.daily(with_total=True), R.daily_report(e, with_total=True))
    same(live.monthly(with_total=True), R.monthly_report(e, with_total=True))
    same(live.totals(), R.usage_totals(e))
    same(live.activity(), batch_activity(e))


def test_any_order_of_arrival_gives_the_batch_reports(spark, tmp_logs):
    name = f"t-views-{os.path.basename(tmp_logs)}"
    args = dict(name=name, max_files_per_trigger=1, views=("days", "activity"))
    logs(tmp_logs, 2, 3)
    check_all(spark, tmp_logs, LiveLog(spark, tmp_logs, **args).advance())
    # earlier copies of every call land last, in another session and month
    write(tmp_logs, "projects/p/late.jsonl", [usage(f"2024-04-30T{3 * h:02d}:10:00Z", mid=f"m{h}", requestId="r", sessionId=f"s{h % 2}")
                                              for h in range(6)])
    live = LiveLog(spark, tmp_logs, **args).advance()
    check_all(spark, tmp_logs, live)
    assert live.deltas().where("sign = -1").count() >= 6
    # a view asked for later catches up
    later = LiveLog(spark, tmp_logs, name=name, views=("blocks",)).advance()
    assert later.blocks().agg(F.sum("entry_count")).first()[0] == live.totals().first().total_requests


def test_activity_windows_at_the_very_gap(spark, tmp_logs):
    times = ["2024-05-01T00:00:00Z", "2024-05-01T05:00:00Z", "2024-05-01T10:00:00.001Z", "2024-05-01T20:00:00Z",
             "2024-05-02T00:59:59Z"]
    write(tmp_logs, "projects/p/a.jsonl", [usage(t, sessionId="s") for t in times])
    live = LiveLog(spark, tmp_logs, views=("activity",)).advance()
    same(live.activity(), batch_activity(load_usage(spark, tmp_logs)["entries"]))


def test_runs_merge_by_size_class(spark, tmp_logs):
    log = RunLog(spark, f"{tmp_logs}/runs", "k string, n long", lambda x: x.groupBy("k").agg(F.sum("n").alias("n")))
    assert log.read().count() == 0
    for epoch in range(FANOUT * 2 + 2):
        log.add(spark.createDataFrame([("a", 1), (f"k{epoch}", 1)], "k string, n long"), epoch)
        if epoch == FANOUT:  # a retried trigger counts once
            log.add(spark.createDataFrame([("a", 1), (f"k{epoch}", 1)], "k string, n long"), epoch)
    got = {r.k: r.n for r in log.read().collect()}
    assert got["a"] == FANOUT * 2 + 2 and len(got) == FANOUT * 2 + 3 and set(got.values()) == {1, FANOUT * 2 + 2}
    assert [b - a + 1 for a, b in log.runs()] == [FANOUT, FANOUT, 1, 1]
    # a run without _SUCCESS (the driver was lost while merging) does not count
    os.remove(f"{tmp_logs}/runs/run-8-15/_SUCCESS")
    assert {r.k: r.n for r in log.read().collect()} == got


def test_partials_add_and_take_off(spark):
    rnd = random.Random(5)
    rows = [(f"s{rnd.randrange(3)}" if rnd.random() < 0.9 else None, rnd.choice(["claude-sonnet-4", "<synthetic>", None]),
             f"20{rnd.choice([19, 24])}-0{rnd.randrange(1, 4)}-0{rnd.randrange(1, 9)} 10:00:00", rnd.randrange(100)) for _ in range(200)]
    e = spark.createDataFrame(rows, "session_id string, model string, t string, input_tokens long").select(
        "session_id", "model", F.col("t").cast("timestamp").alias("ts"), "input_tokens", F.lit(None).cast("long").alias("output_tokens"),
        F.lit(1).cast("long").alias("cache_create_tokens"), F.lit(0).cast("long").alias("cache_read_tokens"),
        F.col("input_tokens").alias("total_tokens"), *[(F.col("input_tokens") / 3).cast("decimal(38,12)").alias(c)
                                                       for c in ("api_cost", "cache_create_cost", "cache_read_cost", "cost")])
    cut = F.col("input_tokens") < 40
    parts = [day_partials(e.where(cut)), day_partials(e.where(~cut)), day_partials(e.where(cut).withColumn("sign", F.lit(-1))),
             day_partials(e.where(cut).withColumn("sign", F.lit(1)))]
    p = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    same(daily_from_partials(p, True), R.daily_report(e, with_total=True))
    same(monthly_from_partials(p, True), R.monthly_report(e, with_total=True))
    same(totals_from_partials(p), R.usage_totals(e))
    assert merge_partials(parts[0].unionByName(parts[2])).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert daily_from_partials(none).count() == 0 and totals_from_partials(none).first().total_requests == 0
