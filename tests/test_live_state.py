"""The stateful live operators equal the batch ones whatever the triggers."""

import os
import random

from pyspark.sql import functions as F

from meterline.operators import blocks as B
from meterline.sources.jsonl import load_usage
from meterline.streaming.stateful import LiveLog
from tests.test_jsonl import usage, write

COLS = ["session_id", "start_time", "first_ts", "actual_end_time", "entry_count", "input_tokens", "output_tokens", "total_tokens",
        "cost_usd", "models"]


def logs(root, n, seed):
    """Copies of calls in several files; the file that comes last in the shuffle
    may hold the earliest copy."""
    rnd = random.Random(seed)
    for i in rnd.sample(range(n), n):
        lines = [usage(f"2024-05-{1 + (h + i) % 3:02d}T{(7 * h + i) % 24:02d}:{rnd.choice(['00', '30'])}:00Z", mid=f"m{h}", requestId="r",
                       sessionId=f"s{h % 3}", usage={"input_tokens": 100 * i + h, "output_tokens": 1}) for h in range(6)]
        lines.append(usage(f"2024-05-02T{i:02d}:15:00Z", sessionId="s1"))
        write(root, f"projects/p/f{i}.jsonl", lines)


def rows(df):
    return sorted(map(str, df.select(*COLS).collect()))


def test_any_order_of_arrival_gives_the_batch_blocks(spark, tmp_logs):
    live = LiveLog(spark, tmp_logs, name=f"t-{os.path.basename(tmp_logs)}", max_files_per_trigger=1)
    logs(tmp_logs, 2, 1)
    live.advance()
    want = load_usage(spark, tmp_logs)["entries"]
    assert rows(live.blocks()) == rows(B.identify_blocks(want, 5, "session_id"))
    # an earlier copy of every call lands last: retractions move the blocks
    write(tmp_logs, "projects/p/late.jsonl", [usage(f"2024-04-30T{3 * h:02d}:10:00Z", mid=f"m{h}", requestId="r", sessionId=f"s{h % 2}")
                                              for h in range(6)])
    again = LiveLog(spark, tmp_logs, name=f"t-{os.path.basename(tmp_logs)}", max_files_per_trigger=1).advance()
    want = load_usage(spark, tmp_logs)["entries"]
    assert rows(again.blocks()) == rows(B.identify_blocks(want, 5, "session_id"))
    kept = again.deltas().groupBy("entry_id", "source_file", "line_seq", "ts_us").agg(F.sum("sign").alias("n")).where("n != 0")
    assert kept.where("n != 1").count() == 0 and kept.count() == want.count()
    assert again.deltas().where("sign = -1").count() >= 6 and again.late().count() == 0


def test_late_entries_come_out_as_rows(spark, tmp_logs):
    live = LiveLog(spark, tmp_logs, retention=24 * 3600.0)
    write(tmp_logs, "projects/p/a.jsonl", [usage("2024-05-01T10:00:00Z", sessionId="s"), usage("2024-05-05T10:00:00Z", sessionId="s")])
    live.advance()
    assert live.blocks().count() == 2 and live.late().count() == 0
    write(tmp_logs, "projects/p/b.jsonl", [usage("2024-05-01T11:00:00Z", sessionId="s"), usage("2024-05-05T11:00:00Z", sessionId="s"),
                                           usage("2024-05-01T11:00:00Z", sessionId="t")])
    live.advance()
    late = live.late().collect()
    assert [(r.key, r.entry_count) for r in late] == [("s", 1)]
    assert sum(r.entry_count for r in live.blocks().collect()) + len(late) == 5
