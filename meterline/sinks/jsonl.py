"""Writing usage logs as ``.jsonl`` files.

Spark's text writer cannot name files, so each task writes the files of the
paths it owns through the Arrow file-system layer (local, HDFS or object
stores alike).  Rows are hash-partitioned by path and sorted inside the
task, so every file is written by exactly one task, in line order.  A task
attempt writes to a private temporary name and moves the finished file into
place, so a retried or speculative attempt never exposes a partial file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _open_fs(root_uri: str):
    from pyarrow import fs as pafs
    if root_uri.startswith("file:") and not root_uri.startswith("file://"):
        root_uri = "file://" + root_uri[len("file:"):]
    elif root_uri.startswith("/"):
        root_uri = "file://" + root_uri
    filesystem, base = pafs.FileSystem.from_uri(root_uri)
    return filesystem, base.rstrip("/")


def write_jsonl(df: DataFrame, root_uri: str, path_col: str = "rel_path", line_col: str = "line",
                order: list[str] | None = None, partitions: int | None = None) -> int:
    """Write ``line_col`` of each row to ``<root>/<rel_path>``; returns the
    number of files.  ``order`` sorts the lines inside each file."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    ordered = (df.repartition(n, path_col)
               .sortWithinPartitions(path_col, *(order or []))
               .select(F.col(path_col).alias("p"), F.col(line_col).alias("l")))

    def writer(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        attempt = ctx.taskAttemptId() if ctx is not None else 0
        filesystem, base = _open_fs(root_uri)
        current, out, tmp, written = None, None, None, []

        def finish():
            if out is not None:
                out.close()
                filesystem.move(tmp, f"{base}/{current}")

        for pdf in batches:
            for p, line in zip(pdf["p"], pdf["l"]):
                if p != current:
                    finish()
                    current = p
                    parent = f"{base}/{p}".rsplit("/", 1)[0]
                    filesystem.create_dir(parent, recursive=True)
                    tmp = f"{base}/{p}.attempt-{attempt}.tmp"
                    out = filesystem.open_output_stream(tmp)
                    written.append(p)
                out.write((line + "\n").encode("utf-8"))
        finish()
        yield pd.DataFrame({"p": written})

    return ordered.mapInPandas(writer, "p string").count()


def exists(root_uri: str, rel: str) -> bool:
    from pyarrow import fs as pafs
    filesystem, base = _open_fs(root_uri)
    return filesystem.get_file_info(f"{base}/{rel}").type != pafs.FileType.NotFound


def touch(root_uri: str, rel: str) -> None:
    filesystem, base = _open_fs(root_uri)
    with filesystem.open_output_stream(f"{base}/{rel}") as out:
        out.write(b"")
