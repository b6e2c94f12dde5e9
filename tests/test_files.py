"""Log files listed and read in tasks."""

import io
import os

from meterline.sources import files as L
from meterline.sources.jsonl import file_manifest, parse_lines, scan_logs
from meterline.streaming.refresh import load_state, refresh
from tests.test_jsonl import usage, write


def put(root, rel, data):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_any_cut_are_the_whole_files():
    data = b"one\n\nthree\r\n" + b"long " * 9 + b"\nlast"
    for text in (data, data + b"\n", b"\n", b"x", b"\n\n"):
        lines = text.removesuffix(b"\n").split(b"\n") if text else []
        for size in (1, 2, 3, 7, len(text)):
            for block in (1, 4, 100):
                got = [x for at in range(0, len(text), size)
                       for x in L.lines_beginning(io.BytesIO(text), at, min(at + size, len(text)), block)]
                assert [x for _, x in got] == lines
                assert all(text[at:at + len(x)] == x for at, x in got)


def test_scan_lists_and_reads_in_tasks_what_spark_reads(spark, tmp_logs, monkeypatch):
    root = tmp_logs
    put(root, "projects/p/a.jsonl", b"\xef\xbb\xbfbom\nb\r\n\n\xff\xfe\nno end")
    put(root, "projects/p/s/t/u/v/deep.JSONL", b"deep\n" * 5)
    put(root, "projects/top.jsonl", b"top\n")
    put(root, "projects/p/empty.jsonl", b"")
    for hidden in ("projects/.h/a.jsonl", "projects/p/_h/a.jsonl", "projects/p/.a.jsonl", "projects/p/_a.jsonl", "projects/p/a.txt"):
        put(root, hidden, b"hidden\n")
    got = scan_logs(spark, root)
    assert "MapInArrow" in plan(got)  # no file list on the driver
    rows = got.selectExpr("hex(line) AS line", "source_file", "file_mtime", "line_seq").collect()
    whole = file_manifest(spark, root + "/projects")
    assert "MapInArrow" in plan(whole)
    monkeypatch.setattr("meterline.sources.jsonl.in_tasks", lambda spark, root: None)
    want = scan_logs(spark, root)
    assert "MapInArrow" not in plan(want)
    order = lambda rs: [(r.line, r.source_file, r.file_mtime) for r in sorted(rs, key=lambda r: (r.source_file, r.line_seq))]
    assert order(rows) == order(want.selectExpr("hex(line) AS line", "source_file", "file_mtime", "line_seq").collect())
    assert sorted(whole.collect()) == sorted(file_manifest(spark, root + "/projects").collect())


def test_long_files_are_cut_and_keep_their_order(spark, tmp_logs, monkeypatch):
    monkeypatch.setattr(L, "SPLIT", 50)
    lines = [f"line {i}" for i in range(100)]
    write(tmp_logs, "projects/p/a.jsonl", lines)
    rows = scan_logs(spark, tmp_logs).collect()
    assert len({r.file_block_start for r in rows}) > 5
    assert [r.line for r in sorted(rows, key=lambda r: (r.source_file, r.file_block_start, r.line_seq))] == lines


def test_unreadable_files_end_the_job_unless_skipped(spark, tmp_logs):
    a = write(tmp_logs, "projects/p/a.jsonl", ["a"])
    write(tmp_logs, "projects/p/b.jsonl", ["b"])
    strict, lenient = scan_logs(spark, tmp_logs), scan_logs(spark, tmp_logs, skip_unreadable=True)
    os.remove(a)
    assert [r.line for r in lenient.collect()] == ["b"]
    try:
        strict.collect()
    except Exception as e:
        assert "a.jsonl" in str(e)
    else:
        raise AssertionError("a lost file was left out")


def test_refresh_reads_new_and_changed_files_only(spark, tmp_logs):
    write(tmp_logs, "projects/p/a.jsonl", [usage("2024-05-01T10:00:00Z", sessionId="s")])
    state = load_state(spark, tmp_logs)
    b = write(tmp_logs, "projects/p/b.jsonl", [usage("2024-05-01T11:00:00Z", sessionId="s")])
    out = refresh(spark, tmp_logs, state)
    assert out["entries"].count() == 2
    os.remove(b)
    out = refresh(spark, tmp_logs, out)
    assert out["entries"].count() == 1 and [r.status for r in out["diff"].orderBy("path").collect()] == ["unchanged", "deleted"]


def test_a_stage_too_long_to_compile_is_not_fused(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_parsed_once_gives_the_same_parts(spark, tmp_logs):
    write(tmp_logs, "projects/p/a.jsonl", [usage("2024-05-01T10:00:00Z", sessionId="s"), "{bad"])
    for how in (None, "checkpoint"):
        parts = parse_lines(scan_logs(spark, tmp_logs), how)
        assert parts["entries"].first().file_first_ts is not None and parts["rejects"].count() == 1


def test_a_tree_is_deleted_in_tasks_and_nothing_beside_it(spark, tmp_logs):
    beside = put(tmp_logs, "beside/d/a.jsonl", b"x")
    for i in range(20):
        put(tmp_logs, f"gone/p{i % 3}/s{i}/t/f.jsonl", b"x")
    put(tmp_logs, "gone/top.jsonl", b"x")
    put(tmp_logs, "gone/p0/.hidden", b"x")
    os.symlink(f"{tmp_logs}/beside", f"{tmp_logs}/gone/link")
    os.symlink(f"{tmp_logs}/beside/d", f"{tmp_logs}/gone/p0/link")
    rows = L._dealt_out(spark, f"file:{tmp_logs}/gone", True).mapInArrow(L._deleting(f"file:{tmp_logs}/gone"), "n long")
    assert sum(r.n for r in rows.collect()) == 22  # 20 folders and 2 files; before, the driver deleted one by one
    L.delete_tree(spark, f"{tmp_logs}/gone")  # again, as another attempt would
    assert not os.path.exists(f"{tmp_logs}/gone") and os.path.exists(beside)
    put(tmp_logs, "gone/p0/s/f.jsonl", b"x")
    L.delete_tree(spark, f"{tmp_logs}/gone")
    assert os.listdir(tmp_logs) == ["beside"]
