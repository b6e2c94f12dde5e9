import os
import shutil

from meterline.sources.jsonl import load_usage
from meterline.streaming.store import UsageStore
from tests.test_jsonl import usage, write

COLS = ["ts", "source_file", "message_id", "request_id", "input_tokens", "session_id", "session_name", "file_first_ts", "cost"]


def call(t, mid=None, sid="s", tokens=1):
    key = {"mid": mid, "requestId": "r"} if mid else {}
    return usage(t, sessionId=sid, usage={"input_tokens": tokens, "output_tokens": 1}, **key)


def rows(entries):
    return sorted(map(str, entries.select(*COLS).collect()))


def test_refresh_by_keys_equals_full_load(spark, tmp_logs):
    path = tmp_logs + "-store"
    title = '{"type":"custom-title","customTitle":"%s","sessionId":"s"}'
    for i in range(4):  # the same calls in several files, and calls without a key
        write(tmp_logs, f"projects/p/f{i}.jsonl", [call(f"2024-05-0{d}T0{i}:00:00Z", f"m{d}", tokens=10 * i + d) for d in range(1, 6)]
              + [call(f"2024-05-0{i + 1}T10:00:00Z", sid=f"s{i}", tokens=i)])
    store = UsageStore(spark, tmp_logs, path)
    first = store.refresh()
    assert first["changed"] == 4 and len(first["days"]) == 5

    def check(days, **statuses):
        store = UsageStore(spark, tmp_logs, path)  # from its commit
        out = store.refresh()
        got = {r.status: r["count"] for r in out["diff"].groupBy("status").count().collect()}
        assert got == statuses
        assert out["days"] == days
        assert rows(store.entries()) == rows(load_usage(spark, tmp_logs)["entries"])
        assert store.refresh()["changed"] == 0
        return store

    check([], unchanged=4)
    # an append touches one day
    with open(f"{tmp_logs}/projects/p/f3.jsonl") as f:
        old = f.read()
    assert old.count("\n") >= 5
    write(tmp_logs, "projects/p/f3.jsonl", [*old.rstrip("\n").split("\n"), call("2024-05-09T10:00:00Z", "m9")])
    check(["2024-05-04", "2024-05-09"], changed=1, unchanged=3)
    # the winner of every keyed call goes: the copies of the next file win
    os.remove(f"{tmp_logs}/projects/p/f0.jsonl")
    check([f"2024-05-0{d}" for d in range(1, 6)], deleted=1, unchanged=3)
    # an earlier copy of one call lands: one day
    write(tmp_logs, "projects/q/a.jsonl", [call("2024-05-02T00:30:00Z", "m2", sid="t", tokens=77)])
    check([], new=1, unchanged=3)
    write(tmp_logs, "projects/q/b.jsonl", [call("2024-05-01T00:00:00Z", "m2", sid="t", tokens=78), title % "named"])
    s = check(["2024-05-01", "2024-05-02"], new=1, unchanged=4)
    assert {r.session_name for r in s.entries().where("session_id = 's'").collect()} == {"named"}
    # a day that loses its last entry has no folder any more
    write(tmp_logs, "projects/p/f3.jsonl", ["{broken"])
    s = check(["2024-05-04", "2024-05-09"], changed=1, unchanged=4)
    assert "2024-05-09" not in s.days
    # compacted, the store gives the same and goes on
    before = rows(s.entries())
    s.compact()
    s.vacuum()
    assert rows(s.entries()) == before == rows(UsageStore(spark, tmp_logs, path).entries())
    for table in ("parsed", "facts", "files", "commits"):
        assert len([f for f in os.listdir(f"{path}/{table}") if not f.startswith(".")]) == 1
    write(tmp_logs, "projects/q/b.jsonl", [call("2024-05-03T00:00:00Z", "m3", sid="t")])
    check(["2024-05-01", "2024-05-02"], changed=1, unchanged=4)


def test_refresh_that_dies_is_done_again(spark, tmp_logs, monkeypatch):
    path = tmp_logs + "-store"
    write(tmp_logs, "projects/p/a.jsonl", [call("2024-05-01T00:00:00Z", "m1"), call("2024-05-02T00:00:00Z", "m2")])
    store = UsageStore(spark, tmp_logs, path)
    store.refresh()
    before = rows(store.entries())
    write(tmp_logs, "projects/p/b.jsonl", [call("2024-05-03T00:00:00Z", "m3")])

    def dies(*_):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as m:
        m.setattr(UsageStore, "_commit", dies)
        try:
            store.refresh()
        except RuntimeError:
            pass
    assert rows(UsageStore(spark, tmp_logs, path).entries()) == before
    shutil.rmtree(f"{tmp_logs}/projects/p", ignore_errors=False)
    write(tmp_logs, "projects/p/c.jsonl", [call("2024-05-04T00:00:00Z", "m4")])
    store = UsageStore(spark, tmp_logs, path)
    store.refresh()
    assert rows(store.entries()) == rows(load_usage(spark, tmp_logs)["entries"])
    assert list(store.days) == ["2024-05-04"]


def test_empty_root(spark, tmp_logs):
    os.makedirs(f"{tmp_logs}/projects")
    store = UsageStore(spark, tmp_logs, tmp_logs + "-store")
    assert store.refresh()["changed"] == 0
    assert store.entries().count() == 0


def test_each_kind_is_written_by_a_writer_of_its_own(spark, tmp_logs):
    write(tmp_logs, "projects/p/a.jsonl", [call("2024-05-01T00:00:00Z", "m1"), "{broken", "", '{"type":"agent-name","agentName":"n","sessionId":"s"}'])
    seen = []

    class Spy(UsageStore):
        def _next_files(self, gen, diff):
            path = f"{self.path}/parsed/gen={gen}"
            seen.append({d: len([f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")]) for d in os.listdir(path) if d.startswith("kind=")})
            seen.append(self.spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
            return super()._next_files(gen, diff)

    store = Spy(spark, tmp_logs, tmp_logs + "-store")
    store.refresh()
    assert seen[0] == {f"kind={k}": 1 for k in ("entry", "reject", "blank", "name")}
    assert rows(store.entries()) == rows(load_usage(spark, tmp_logs)["entries"])
    # the option holds for that write alone
    assert seen[1] == "0"
