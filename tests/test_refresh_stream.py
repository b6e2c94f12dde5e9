import datetime as dt
import json
import os

from pyspark.sql import functions as F

from meterline.streaming.refresh import load_state, manifest_diff, refresh
from meterline.streaming.live import run_available_now, stream_dedup, stream_logs
from tests.test_jsonl import usage, write


def test_manifest_diff_statuses(spark):
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("/r/projects/a/1.jsonl", t, 10), ("/r/projects/a/2.jsonl", t, 10),
                                 ("/r/projects/b/3.jsonl", t, 10)], "path string, modification_time timestamp, length long")
    new = spark.createDataFrame([("/r/projects/a/1.jsonl", t, 10), ("/r/projects/a/2.jsonl", t, 20),
                                 ("/r/projects/c/4.jsonl", t, 10)], "path string, modification_time timestamp, length long")
    got = {r.path.rsplit("/", 1)[1]: r.status for r in manifest_diff(old, new).collect()}
    assert got == {"1.jsonl": "unchanged", "2.jsonl": "changed", "3.jsonl": "deleted", "4.jsonl": "new"}


def test_refresh_equals_full_load(spark, tmp_logs):
    write(tmp_logs, "projects/p/a.jsonl", [usage("2024-05-01T10:00:00Z", mid="m1", requestId="r", sessionId="s")])
    state = load_state(spark, tmp_logs)
    assert state["entries"].count() == 1
    # the file grows in place, a new file lands, an old copy is repeated
    write(tmp_logs, "projects/p/a.jsonl", [usage("2024-05-01T10:00:00Z", mid="m1", requestId="r", sessionId="s"),
                                           usage("2024-05-01T11:00:00Z", mid="m2", requestId="r", sessionId="s")])
    write(tmp_logs, "projects/q/b.jsonl", [usage("2024-05-02T10:00:00Z", mid="m1", requestId="r", sessionId="t"),
                                           usage("2024-05-02T10:00:00Z", sessionId="t")])
    out = refresh(spark, tmp_logs, state)
    assert sorted(r.status for r in out["diff"].collect()) == ["changed", "new"]
    assert out["entries"].count() == 3
    again = refresh(spark, tmp_logs, out)          # nothing changed: same result
    assert again["entries"] is out["entries"]


def test_watermark_dedup_forgets_old_keys(spark, tmp_logs):
    one = [usage("2024-05-01T10:00:00Z", mid="m1", requestId="r", sessionId="s"), usage("2024-05-01T10:00:00Z", sessionId="s")]
    write(tmp_logs, "projects/p/a.jsonl", [*one, one[0], usage("2024-05-03T10:00:00Z", mid="m2", requestId="r", sessionId="s")])
    out = run_available_now(stream_dedup(stream_logs(spark, tmp_logs), "1 hour"), "t-dedup")
    # the copy is dropped; the entry without an id passes
    assert sorted(str(r.message_id) for r in out.collect()) == ["None", "m1", "m2"]


def test_refresh_interval_is_clamped_and_live_query_runs(spark, tmp_logs):
    import time
    from meterline.streaming.live import refresh_interval, run_live
    assert refresh_interval(0.2) == "1 seconds" and refresh_interval(600) == "60 seconds"
    write(tmp_logs, "projects/p/a.jsonl", [usage("2024-05-01T10:00:00Z", sessionId="s")])
    seen = []
    q = run_live(stream_logs(spark, tmp_logs), f"live_{int(time.time())}", lambda batch, epoch: seen.append(batch.count()), 1, "append")
    try:
        q.processAllAvailable()
        assert seen == [1]
    finally:
        q.stop()


def test_live_reports_do_not_depend_on_triggers(spark, tmp_logs):
    from meterline.operators import reports as R
    from meterline.sources.jsonl import load_usage
    from meterline.streaming.live import live_reports
    for i in range(4):  # the same calls in every file; the earliest file's copies count
        write(tmp_logs, f"projects/p/f{i}.jsonl", [
            usage(f"2024-05-01T{(h + 7 * i) % 24:02d}:00:00Z", mid=f"m{h}", requestId="r", sessionId=f"s{i}",
                  usage={"input_tokens": 10 * i + h, "output_tokens": 1}) for h in range(5)])
    want = R.daily_report(load_usage(spark, tmp_logs)["entries"]).collect()
    for n in (None, 1):
        got = live_reports(spark, tmp_logs, f"t-live-{n}-{os.path.basename(tmp_logs)}", {"daily": R.daily_report},
                           max_files_per_trigger=n)["daily"]
        assert sorted(map(str, got.collect())) == sorted(map(str, want))
