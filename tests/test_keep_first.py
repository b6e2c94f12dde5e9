"""The copy that counts is held by Spark's own state, without a Python call per entry."""

import os

from pyspark.sql import functions as F

from meterline.sources.jsonl import load_usage
from meterline.streaming.stateful import LiveLog, _ENTRY, keep_first
from tests.test_jsonl import usage, write


def test_keyed_state_is_a_builtin_aggregate(spark, tmp_logs):
    stream = spark.readStream.schema(_ENTRY + ", epoch long").parquet(tmp_logs)
    plan = keep_first(stream)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Aggregate [message_id" in plan


def test_copies_replaced_twice_lost_and_without_ids(spark, tmp_logs):
    live = LiveLog(spark, tmp_logs, f"t-keep-{os.path.basename(tmp_logs)}", views=("days",))
    for n, day in enumerate((9, 5, 7, 2)):  # replaced, lost, replaced once more
        write(tmp_logs, f"projects/p/f{day}.jsonl", [
            usage(f"2024-05-{day:02d}T10:00:00Z", mid="m", requestId="r", sessionId=f"s{day}"),
            usage(f"2024-05-{day:02d}T10:00:00Z", mid=f"own{day}", requestId="r", sessionId=f"s{day}"),
            usage(f"2024-05-{day:02d}T11:00:00Z", sessionId=f"s{day}")])
        live.advance()
        assert live.totals().first().total_requests == 1 + 2 * (n + 1)
    signs = live.deltas().where("message_id = 'm'").groupBy("session_id").agg(F.collect_list("sign").alias("signs")).collect()
    assert {r.session_id: sorted(r.signs) for r in signs} == {"s9": [-1, 1], "s5": [-1, 1], "s2": [1]}
    e = load_usage(spark, tmp_logs)["entries"]
    assert sorted(live.kept("message_id", "session_id").collect(), key=str) == sorted(e.select("message_id", "session_id").collect(), key=str)
