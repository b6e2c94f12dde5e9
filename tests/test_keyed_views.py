"""Blocks and activity sessions kept by runs laid out by key, no row through Python."""

import os
import re

from pyspark.sql import functions as F

from meterline.streaming import runs
from meterline.streaming.runs import BUCKETS, KeyedLog
from meterline.streaming.stateful import COSTS, TOKENS, LiveBlocks, LiveLog, _DELTA, block_view, live_activity, window_view
from tests.test_jsonl import usage, write

HOUR = 3600 * 10 ** 6


def deltas(spark, *rows):
    """(sign, session, hour, model, tokens, cost) as signed rows."""
    made = spark.createDataFrame([(s, k, int(h * HOUR), m, n, c) for s, k, h, m, n, c in rows],
                                 "sign int, session_id string, ts_us long, model string, n long, c string")
    return made.select("sign", "session_id", "ts_us", "model", *[F.col("n").alias(c) for c in TOKENS], *[F.col("c").alias(c) for c in COSTS])


def shown(blocks):
    return {(r.session_id, r.first_ts.hour, r.entry_count, r.input_tokens, str(r.cost_usd), tuple(r.models))
            for r in block_view(blocks.sent()).collect()}


def test_only_keep_first_holds_streaming_state(spark, tmp_logs):
    write(tmp_logs, "projects/p/a.jsonl", [usage("2024-05-01T10:00:00Z", sessionId="s", mid="m", requestId="r")])
    live = LiveLog(spark, tmp_logs, views=("blocks", "activity")).advance()
    base = live.base.removeprefix("file:")
    assert [d for d in os.listdir(base) if os.path.exists(f"{base}/{d}/state")] == ["deltas-checkpoint"]
    assert live.blocks().count() == live.activity().count() == 1


def test_rows_of_some_keys_are_read_from_their_folders(spark, tmp_logs):
    log = KeyedLog(spark, f"{tmp_logs}/log", "key string, n long", lambda x: x.groupBy("key").agg(F.sum("n").alias("n")))
    for epoch in range(2):
        log.add(spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).cast("long").alias("n")).unionByName(
            spark.createDataFrame([(None, 7)], "key string, n long")), epoch)
    some = spark.createDataFrame([("k7",), (None,)], "key string")
    got = log.read_keys(some, before=2)
    assert sorted(map(tuple, got.collect()), key=str) == [("k7", 2), (None, 14)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)  # folders without these keys are not read
    every = {f.split("/bucket=")[1].split("/")[0] for f in log._load(log.runs()).inputFiles()}
    assert 2 < len(every) <= BUCKETS
    assert log.read_keys(some, before=0).count() == 0
    assert all(len(os.listdir(f"{tmp_logs}/log/run=0-0/bucket={b}")) == 2 for b in every)  # one file and its checksum


def test_copies_replaced_at_the_same_time(spark, tmp_logs):
    tiny = "0.000000000001"
    a, b = ("s", 10.5, "m", 5, tiny), ("s", 10.5, "m", 3, "2")
    blocks = LiveBlocks(spark, f"{tmp_logs}/blocks")
    blocks.add(deltas(spark, (1, *a), (1, "s", 11, "x", 1, "1"), (1, None, 3, None, 4, "0")), 0)
    alone = (None, 3, 1, 4, "0E-12", ())
    assert shown(blocks) == {alone, ("s", 10, 2, 6, "1.000000000001", ("m", "x"))}
    for _ in range(2):  # a retried trigger counts once
        blocks.add(deltas(spark, (-1, *a), (1, *b)), 1)
        assert shown(blocks) == {alone, ("s", 10, 2, 4, "3.000000000000", ("m", "x"))}
    # its first entry goes: the block begins later, the one before is no more
    blocks.add(deltas(spark, (-1, *b)), 2)
    assert shown(blocks) == {alone, ("s", 11, 1, 1, "1.000000000000", ("x",))}
    sent = blocks.sent().where("epoch = 2").orderBy("start_us").collect()
    assert [(r.start_us // HOUR, r.entry_count) for r in sent] == [(10, 0), (11, 1)]


def test_forgotten_blocks_stay_as_sent(spark, tmp_logs, monkeypatch):
    monkeypatch.setattr(runs, "FANOUT", 2)
    day, model = 24.0, ("m", 1, "1")
    blocks = LiveBlocks(spark, f"{tmp_logs}/blocks", retention=24 * 3600.0)
    blocks.add(deltas(spark, (1, "s", 1, *model), (1, "s", 5.5, *model), (1, "t", 2, *model)), 0)
    for epoch in range(1, 5):  # runs are merged on the way
        blocks.add(deltas(spark, (1, "s", 1 + day * epoch, *model), (1, "s", 0.5, *model)), epoch)
    view = block_view(blocks.sent())
    assert view.where("session_id = 's'").agg(F.sum("entry_count")).first()[0] == 2 + 4 + 1  # the first 0.5 was in time
    assert blocks.sent().where("kind = 'late'").count() == 3
    assert view.where("session_id = 't'").count() == 1
    left = blocks.view.log._load(blocks.view.log.runs()).where("key = 's'").agg(F.min("ts_us")).first()[0]
    assert left > day * HOUR  # merged runs hold no forgotten rows


def test_activity_changes_by_trigger(spark, tmp_logs):
    view = live_activity(spark, f"{tmp_logs}/activity")

    def add(epoch, *rows):
        view.add(spark.createDataFrame([(k, int(h * HOUR), n) for k, h, n in rows], "key string, ts_us long, n long"), epoch)
        return sorted((r.session_id, r.first_ts.hour, r.last_ts.hour, r.entries) for r in window_view(view.sent()).collect() if r.session_id)

    assert add(0, ("s", 1, 1), ("s", 5, 2), ("s", 12, 1), (None, 1, 1)) == [("s", 1, 5, 3), ("s", 12, 12, 1)]
    assert add(1, ("s", 8, 1)) == [("s", 1, 12, 5)]
    assert add(2, ("s", 8, -1), ("t", 1, 1)) == [("s", 1, 5, 3), ("s", 12, 12, 1), ("t", 1, 1, 1)]
    assert view.sent().where("epoch = 2 and key = 's'").count() == 2
    assert window_view(view.sent()).where("session_id is null").count() == 1
