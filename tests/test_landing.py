"""Logs land through a table of files, in triggers sized by bytes."""

import os

from meterline.sources.jsonl import load_usage
from meterline.streaming.stateful import LiveLog
from tests.test_jsonl import usage, write


def test_triggers_follow_bytes_and_each_file_lands_once(spark, tmp_logs):
    line = usage("2024-05-01T10:00:00Z", sessionId="s")
    for i in range(9):
        write(tmp_logs, f"projects/p/f{i}.jsonl", [line])
    live = LiveLog(spark, tmp_logs, f"t-bytes-{os.path.basename(tmp_logs)}", max_bytes_per_trigger=1 << 20, views=("days",)).advance()
    epochs = lambda: len([x for x in os.listdir(live.base.removeprefix("file:") + "/entries") if x.startswith("epoch=")])
    assert epochs() == 1 and live.totals().first().total_requests == 9
    live.advance()  # nothing new
    assert epochs() == 1
    for i in range(9, 12):
        write(tmp_logs, f"projects/p/f{i}.jsonl", [line])
    live.max_bytes = len(line) + 1
    live.advance()
    assert 2 <= epochs() <= 4 and live.totals().first().total_requests == 12
    assert load_usage(spark, tmp_logs)["entries"].count() == 12
