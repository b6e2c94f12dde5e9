"""Log files listed and read in tasks (O1.1, O1.2, O8.1).

Spark's file sources list every file on the driver.  Logs are many small files,
so here a listing is a data frame: tasks list the directories through the Arrow
file-system layer and the rows, one per file, stay in tasks and tables.  Reading
takes such rows, cuts long files into splits and yields the lines that begin in
each, so neither the driver nor one task ever holds the list of files.

Roots that Arrow cannot open (other schemes, globs, single files) are read by
Spark's own sources (``in_tasks`` is None for them).
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The readers travel with the query: the process that runs them need not have this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = 64 << 20
BLOCK = 4 << 20
ROWS = 10_000
OPEN_COST = 64 << 10
_LISTED = "path string, modified_ms long, length long"  # a directory has no length
_LINES = "line binary, source_file string, file_block_start long, modified_us long, line_seq long"


def storage(uri: str):
    """(file system, path in it, what stands before a path in a file's name)."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", uri).rstrip("/"), ""
    filesystem, path = fs.FileSystem.from_uri(uri)
    return filesystem, path.rstrip("/"), uri.rstrip("/").removesuffix(path.rstrip("/"))


def in_tasks(spark: SparkSession, root: str) -> str | None:
    """The full URI of ``root`` if it is a directory that tasks can list."""
    from pyarrow import fs
    if re.search(r"[*?\[\]{}\\]", root):
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    try:
        filesystem, path, _ = storage(uri)
        return uri if filesystem.get_file_info(path).type == fs.FileType.Directory else None
    except (OSError, ValueError, NotImplementedError):
        return None


def _visible(name: str) -> bool:
    """Names that Spark's file sources list."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _listing(uri: str, whole: bool, hidden: bool):
    """Directories replaced by what is in them, with ``whole`` down to the files."""
    def expand(batches):
        import pyarrow as pa
        from pyarrow import fs
        filesystem, _, _ = storage(uri)

        def below(path: str) -> Iterator[tuple]:
            folders = [path]
            while folders:
                for f in filesystem.get_file_info(fs.FileSelector(folders.pop())):
                    if not hidden and not _visible(f.base_name):
                        continue
                    if f.type != fs.FileType.Directory:
                        yield f.path, (f.mtime_ns or 0) // 1_000_000, f.size or 0
                    elif whole:
                        folders.append(f.path)
                    else:
                        yield f.path, None, None

        def batch(rows):
            path, modified, length = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(modified, pa.int64()), pa.array(length, pa.int64())],
                                              ["path", "modified_ms", "length"])

        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                for found in (row,) if row[2] is not None else below(row[0]):
                    rows.append(found)
                    if len(rows) >= ROWS:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)
    return expand


def _dealt_out(spark: SparkSession, uri: str, hidden: bool) -> DataFrame:
    """What is two folders below ``uri``, and the files above, dealt out to tasks twice
    on the way down: one folder with most of the files is not one task."""
    _, base, _ = storage(uri)
    n = 4 * spark.sparkContext.defaultParallelism
    found = spark.range(1, numPartitions=1).select(
        F.lit(base or "/").alias("path"), F.lit(None).cast("long").alias("modified_ms"), F.lit(None).cast("long").alias("length"))
    return found.mapInArrow(_listing(uri, False, hidden), _LISTED).repartition(n, "path") \
        .mapInArrow(_listing(uri, False, hidden), _LISTED).repartition(n, "path")


def list_all(spark: SparkSession, uri: str, hidden: bool = False) -> DataFrame:
    """``(path, modification_time, length)`` of every file below ``uri``, with
    ``hidden`` also of those that Spark's file sources leave out."""
    _, _, before = storage(uri)
    found = _dealt_out(spark, uri, hidden).mapInArrow(_listing(uri, True, hidden), _LISTED)
    return found.select(F.concat(F.lit(before), "path").alias("path"), F.timestamp_millis("modified_ms").alias("modification_time"), "length")


def _deleting(uri: str):
    def delete(batches):
        import os
        import pyarrow as pa
        filesystem, _, before = storage(uri)
        n = 0
        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                if not before and (os.path.islink(path) or os.path.islink(os.path.dirname(path))):
                    continue  # the link goes, not what it points to; that is left to the driver
                try:
                    filesystem.delete_dir(path) if length is None else filesystem.delete_file(path)
                    n += 1
                except FileNotFoundError:  # another attempt of this task was first
                    pass
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])
    return delete


def delete_tree(spark: SparkSession, root: str) -> None:
    """Delete ``root`` and all below, in tasks where tasks can list it; the driver
    deletes no more than its two uppermost levels of folders."""
    uri = in_tasks(spark, root)
    if uri:
        _dealt_out(spark, uri, True).mapInArrow(_deleting(uri), "n long").agg(F.sum("n")).first()
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def list_files(spark: SparkSession, uri: str) -> DataFrame:
    """``(path, modification_time, length)`` of every ``*.jsonl`` file below ``uri``
    that is not empty, as Spark's file sources list them."""
    return list_all(spark, uri).where(F.lower("path").endswith(".jsonl") & (F.col("length") > 0))


def lines_beginning(f, begin: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of every line that begins in ``begin`` to ``end``."""
    at = max(begin - 1, 0)
    f.seek(at)
    skip, open_line, first = begin > 0, [], begin == 0
    while at < end:
        data = f.read(block)
        if not data:
            if open_line and not skip:
                yield at, b"".join(open_line)
            return
        if first:
            data, first = data.removeprefix(b"\xef\xbb\xbf"), False  # byte order mark
        *whole, rest = data.split(b"\n")
        for line in whole:
            if open_line:
                line = b"".join([*open_line, line])
                open_line = []
            if skip:
                skip = False
            elif at < end:
                yield at, line
            else:
                return
            at += len(line) + 1
        if rest:
            open_line.append(rest)


def _reading(uri: str, skip_unreadable: bool):
    def read(batches):
        import pyarrow as pa
        filesystem, _, before = storage(uri)
        rows: list[list] = [[], [], [], [], []]
        size = 0

        def batch():
            kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)],
                                              ["line", "source_file", "file_block_start", "modified_us", "line_seq"])

        for b in batches:
            for path, modified, begin, end in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    with filesystem.open_input_file(path.removeprefix(before)) as f:
                        for at, line in lines_beginning(f, begin, end):
                            for column, value in zip(rows, (line, path, begin, modified, at)):
                                column.append(value)
                            size += len(line)
                            if len(rows[0]) >= ROWS or size >= BLOCK:
                                yield batch()
                                rows, size = [[], [], [], [], []], 0
                except OSError:
                    if not skip_unreadable:
                        raise
        if rows[0]:
            yield batch()
    return read


def tasks_for(spark: SparkSession, count: int, size: int) -> int:
    """How many tasks read ``count`` files of ``size`` bytes."""
    cost = size + count * OPEN_COST
    return max(1, math.ceil(cost / min(SPLIT, max(BLOCK, cost // spark.sparkContext.defaultParallelism + 1))))


def read_files(files: DataFrame, uri: str, tasks: int, skip_unreadable: bool = False) -> DataFrame:
    """Lines ``(line, source_file, file_block_start, file_mtime, line_seq)`` of
    listed ``files`` below ``uri``; ``line_seq`` is the line's first byte."""
    splits = files.select(
        "path", F.unix_micros("modification_time").alias("modified_us"), "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(SPLIT).cast("long"))).alias("begin")) \
        .select("path", "modified_us", "begin", F.least(F.col("begin") + SPLIT, F.col("length")).alias("end"))
    return splits.repartition(tasks).mapInArrow(_reading(uri, skip_unreadable), _LINES).select(
        F.col("line").cast("string").alias("line"), "source_file", "file_block_start",
        F.timestamp_micros("modified_us").alias("file_mtime"), "line_seq")
