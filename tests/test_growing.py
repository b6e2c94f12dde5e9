"""Logs that grow in place are read once per byte and equal a full load."""

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from meterline.operators import reports as R
from meterline.sources.growing import appended_lines, in_tasks, split_appended
from meterline.sources.jsonl import load_usage
from meterline.streaming.stateful import LiveLog
from tests.test_jsonl import usage
from tests.test_live_views import same


def append(root, rel, text):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def test_every_line_comes_once_however_the_bytes_are_cut():
    rnd = random.Random(1)
    for _ in range(200):
        data = "".join(rnd.choice(["a", "é", "\n", "\r\n", "x" * rnd.randrange(50)]) for _ in range(rnd.randrange(40))).encode()
        cuts = sorted(rnd.randrange(len(data) + 1) for _ in range(rnd.randrange(5)))
        edges = [0, *cuts, len(data)]
        got = []
        for a, b in zip(edges, edges[1:]):
            for part in split_appended({"f": a}, {"f": b}, False, split=rnd.randrange(1, 30)):
                got += appended_lines(io.BytesIO(data[:b]), part.begin, part.end, block=rnd.randrange(1, 20))
        whole, at = [], 0
        for line in data.split(b"\n")[:-1]:
            whole.append((at, line))
            at += len(line) + 1
        assert got == whole


def test_long_line_and_truncated_files():
    data = b"x" * 300_000 + b"\n"
    assert [len(line) for _, line in appended_lines(io.BytesIO(data), 200_000, len(data), block=1000)] == [300_000]
    assert list(appended_lines(io.BytesIO(data), 0, 200_000)) == []
    with pytest.raises(ValueError, match="truncated"):
        split_appended({"f": 10}, {"f": 4}, False)
    assert [(p.begin, p.end) for p in split_appended({"f": 10, "gone": 5}, {"f": 4}, True)] == [(0, 4)]


def test_small_ranges_share_a_task_and_none_is_lost():
    ranges = split_appended({}, {f"f{i:04d}": i * 1000 for i in range(1000)} | {"big": 200 << 20}, False)
    tasks = in_tasks(ranges)
    assert [r for t in tasks for r in t.ranges] == ranges and 8 <= len(tasks) <= 80
    assert in_tasks([]) == []


def test_appended_logs_equal_a_full_load(spark, tmp_logs):
    def line(hour, mid=None, day=2, **kw):
        return usage(f"2024-05-{day:02d}T{hour:02d}:00:00Z", **({"mid": mid, "requestId": "r"} if mid else {}), **kw)

    live = LiveLog(spark, tmp_logs, growing=True, views=("days",))
    a, b = "projects/p/a.jsonl", "projects/p/b.jsonl"
    append(tmp_logs, a, line(10, "m1", sessionId="s") + "\n" + line(11, sessionId="s") + "\n")
    append(tmp_logs, b, line(9, "m1", sessionId="t") + "\n")  # b begins earlier: its copy counts
    live.advance()
    same(live.daily(True), R.daily_report(load_usage(spark, tmp_logs)["entries"], with_total=True))
    # an append that ends inside a line, with copies of known calls
    half = line(12, "m2", sessionId="s")
    append(tmp_logs, a, line(10, "m1", sessionId="s") + "\n" + half[:40])
    live.advance()
    assert live.totals().first().total_requests == 2
    # its rest; a now holds an earlier time than b, so the copies of a count, also those read before
    append(tmp_logs, a, half[40:] + "\n" + line(1, day=1, sessionId="u") + "\n")
    live.advance()
    e = load_usage(spark, tmp_logs)["entries"]
    same(live.daily(True), R.daily_report(e, with_total=True))
    same(live.totals(), R.usage_totals(e))
    kept = live.kept("message_id", "session_id")
    assert sorted(map(str, kept.collect())) == sorted(map(str, e.select("message_id", "session_id").collect()))
    assert kept.where("message_id = 'm1'").first().session_id == "s"
    # every line was read once
    read = spark.read.parquet(f"{live.base}/parsed")
    assert read.count() == 6 and read.select("source_file", "line_seq").distinct().count() == 6
    live.advance()  # nothing new
    assert live.totals().first().total_requests == e.count()


def test_a_shorter_file_is_detected(spark, tmp_logs):
    path = append(tmp_logs, "projects/p/a.jsonl", usage("2024-05-02T10:00:00Z", sessionId="s") + "\n")
    live = LiveLog(spark, tmp_logs, growing=True, views=())
    live.advance()
    with open(path, "w") as f:
        f.write("\n")
    with pytest.raises(Exception, match="truncated or replaced"):
        live.advance()
