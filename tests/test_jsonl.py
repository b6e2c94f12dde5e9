import json
import os
import time

from meterline.sources.jsonl import load_usage, parse_lines, scan_logs


def write(root, rel, lines):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    return p


def usage(ts, **kw):
    msg = {"id": kw.pop("mid", None), "model": kw.pop("model", "claude-sonnet-4-20250514"),
           "usage": kw.pop("usage", {"input_tokens": 10, "output_tokens": 5})}
    d = {"timestamp": ts, "message": msg, **kw}
    return json.dumps(d)


def test_parse_rules_and_rejects(spark, tmp_logs):
    write(tmp_logs, "projects/proj-a/s1.jsonl", [
        usage("2024-05-01T10:00:00Z", mid="m1", requestId="r1", sessionId="s1"),
        "",
        "{bad",
        json.dumps({"timestamp": "2024-05-01T10:00:00Z", "type": "summary"}),
        json.dumps({"timestamp": "2024-05-01T10:00:00Z", "type": "user", "message": {"role": "user"}}),
        json.dumps({"timestamp": "2024-05-01T10:00:00Z", "message": {"usage": {"input_tokens": "5",
                                                                             "output_tokens": 1}}}),
        json.dumps({"timestamp": "2024-05-01T10:00:00Z", "message": {"usage": {"output_tokens": 1}}}),
        usage("2019-12-31T23:00:00Z"),
        usage("not a time"),
        usage("2024-05-01T10:00:00Z", model="x", message_override=None) if False else
        json.dumps({"timestamp": "2024-05-01T10:00:00Z", "message": {"model": "<synthetic>",
                                                                     "usage": {"input_tokens": 1, "output_tokens": 1}}}),
        usage(1714557600.9, sessionId="s-num", session_id="s-flat",
              usage={"input_tokens": 3.9, "output_tokens": 2, "cache_creation_input_tokens": 7},
              cache_read_input_tokens=11, cost=0.5, costUSD=0.7),
        json.dumps({"type": "custom-title", "customTitle": "My title", "sessionId": "s1"}),
    ])
    parts = parse_lines(scan_logs(spark, tmp_logs))
    rej = {r.reject_reason: r.counted for r in parts["rejects"].collect()}
    assert rej == {"malformed_json": True, "missing_message": False, "missing_usage": False,
                   "input_tokens_not_number": True, "missing_input_tokens": True, "invalid_time": False,
                   "synthetic": False}
    e = {r.session_id: r for r in parts["entries"].collect()}
    assert set(e) == {"s1", "s-flat"}
    flat = e["s-flat"]
    # number timestamp truncated; tokens truncated; nested cache counted in total, flat one not
    assert flat.ts.isoformat() == "2024-05-01T10:00:00"
    assert (flat.input_tokens, flat.cache_create_tokens, flat.cache_read_tokens) == (3, 7, 11)
    assert flat.total_tokens == 3 + 2 + 7
    assert float(flat.logged_cost) == 0.5   # cost beats costUSD
    assert e["s1"].project_path.endswith("/projects/proj-a")
    assert [(r.session_id, r.name) for r in parts["names"].collect()] == [("s1", "My title")]


def test_load_usage_end_to_end(spark, tmp_logs):
    write(tmp_logs, "projects/p/a.jsonl", [usage("2024-05-01T10:00:00Z", mid="m", requestId="r", sessionId="s",
                                                 usage={"input_tokens": 100, "output_tokens": 0})])
    write(tmp_logs, "projects/p/b.JSONL", [usage("2024-05-01T09:00:00Z", mid="m", requestId="r", sessionId="s",
                                                 usage={"input_tokens": 200, "output_tokens": 0})])
    write(tmp_logs, "projects/p/ignored.txt", [usage("2024-05-01T09:00:00Z")])
    out = load_usage(spark, tmp_logs, materialize_as=None)
    rows = out["entries"].collect()
    # b.JSONL has the earlier first timestamp: its copy is the one kept
    assert len(rows) == 1 and rows[0].input_tokens == 200 and rows[0].date_key == "2024-05-01"


def test_max_files_and_modified_within(spark, tmp_logs):
    import datetime as dt
    old = write(tmp_logs, "projects/p/old.jsonl", [usage("2024-05-01T10:00:00Z", sessionId="old")])
    new = write(tmp_logs, "projects/p/new.jsonl", [usage("2024-05-01T10:00:00Z", sessionId="new")])
    now = time.time()
    os.utime(old, (now - 3 * 86400, now - 3 * 86400))
    os.utime(new, (now, now))
    newest = parse_lines(scan_logs(spark, tmp_logs, max_files=1))["entries"].collect()
    assert [r.session_id for r in newest] == ["new"]
    recent = parse_lines(scan_logs(spark, tmp_logs, modified_within=dt.timedelta(days=1),
                                   as_of=dt.datetime.fromtimestamp(now + 60, dt.UTC).replace(tzinfo=None)))["entries"].collect()
    assert [r.session_id for r in recent] == ["new"]


def test_file_order_looks_at_the_whole_file(spark, tmp_logs):
    # a.jsonl starts at 12:00; its earliest time is on line 102
    lines_a = [""] + [usage("2024-05-01T12:00:00Z", mid=f"a{i}", requestId="r", sessionId="s")
                      for i in range(100)] + [usage("2024-05-01T01:00:00Z", mid="dup", requestId="r", sessionId="s",
                                                    usage={"input_tokens": 1, "output_tokens": 0})]
    write(tmp_logs, "projects/p/a.jsonl", lines_a)
    write(tmp_logs, "projects/p/b.jsonl", [usage("2024-05-01T06:00:00Z", mid="dup", requestId="r", sessionId="s",
                                                 usage={"input_tokens": 2, "output_tokens": 0})])
    parts = parse_lines(scan_logs(spark, tmp_logs))
    order = {r.source_file.rsplit("/", 1)[1]: r.file_first_ts for r in
             parts["entries"].select("source_file", "file_first_ts").distinct().collect()}
    assert order["a.jsonl"].hour == 1 and order["b.jsonl"].hour == 6
    out = load_usage(spark, tmp_logs, materialize_as=None)["entries"].where("message_id = 'dup'").collect()
    assert [r.input_tokens for r in out] == [1]     # a.jsonl loads first, its copy wins


def test_lines_end_at_newlines_and_repeated_keys_keep_the_last(spark, tmp_logs):
    good = usage("2024-05-01T10:00:00Z", sessionId="s")
    write(tmp_logs, "projects/p/a.jsonl", [
        good[:-1] + ',"sessionId":"last"}', good.replace(", ", ",\r", 1), good + "\r", "\t \t", "\r", "{bad"])
    parts = parse_lines(scan_logs(spark, tmp_logs))
    assert sorted(r.session_id for r in parts["entries"].collect()) == ["last", "s", "s"]
    assert [r.reject_reason for r in parts["rejects"].collect()] == ["malformed_json"]


def test_unkeyed_lines_at_one_position_are_all_kept(spark):
    from meterline.operators.dedup import keep_first
    df = spark.createDataFrame([(None, 1, "a"), (None, 1, "b"), ("k", 2, "c"), ("k", 1, "d")], "k string, o int, v string")
    got = keep_first(df, ["k"], ["o"], df["k"].isNotNull())
    assert sorted(r.v for r in got.collect()) == ["a", "b", "d"]
