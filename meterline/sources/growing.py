"""Streaming source of log files that grow in place (O8.3).

A trigger reads, of every ``*.jsonl`` file below the root, the bytes appended
since the trigger before.  A range of bytes yields the lines whose newline lies
in it, so each line comes exactly once, also when an append ends in the middle of
a line (its first part waits for the newline) and when a long range is cut into
splits.  ``grown_lines`` lists the files in tasks into a table of byte ranges, which
the stream reads, so the driver holds no file.  Where tasks cannot list the root the
source ``growing_logs`` does: there the file sizes, one number a file, are read on
the driver and are the offset that the checkpoint keeps; bytes are read in tasks.

A last line without a newline is not yielded until its newline is there (a batch
load reads it at once).  A file that got shorter was truncated or replaced: the
query fails and names it, or with ``truncated="restart"`` reads it from its first
byte again.  A deleted file is forgotten; what was read stays.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from meterline.sources.files import in_tasks as listable
from meterline.sources.files import list_all, storage, tasks_for

# The reader travels with the query: the process that runs it need not have this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = 64 << 20
BLOCK = 4 << 20
ROWS = 10_000
_LINES = "line string, source_file string, file_block_start long, line_seq long"
_RANGES = "path string, listing long, begin long, end long"


@dataclass
class Appended:
    """Bytes ``begin`` to ``end`` of a file."""
    path: str
    begin: int
    end: int


@dataclass
class Task(InputPartition):
    """Ranges that one task reads."""
    ranges: list[Appended]


def in_tasks(ranges: list[Appended], open_cost: int = 256 << 10, least: int = 4 << 20, split: int = SPLIT) -> list[Task]:
    """Consecutive ranges together until they are worth a task."""
    costs = [r.end - r.begin + open_cost for r in ranges]
    target, out, size = min(split, max(least, sum(costs) // 64)), [], 0
    for r, cost in zip(ranges, costs):
        if not out or size + cost > target:
            out.append(Task([]))
            size = 0
        out[-1].ranges.append(r)
        size += cost
    return out


def split_appended(start: dict[str, int], end: dict[str, int], restart: bool, split: int = SPLIT) -> list[Appended]:
    """The byte ranges between two offsets."""
    out = []
    for path, size in sorted(end.items()):
        begin = start.get(path, 0)
        if size < begin:
            if not restart:
                raise ValueError(f"{path} was {begin} bytes long and is {size} now: truncated or replaced")
            begin = 0
        out += [Appended(path, at, min(at + split, size)) for at in range(begin, size, split)]
    return out


def line_start(f, at: int) -> int:
    """Where the line begins that holds the byte before ``at``."""
    end = at
    while end > 0:
        begin = max(0, end - 65536)
        f.seek(begin)
        found = f.read(end - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        end = begin
    return 0


def appended_lines(f, begin: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) for every line whose newline is in ``begin`` to ``end``."""
    at = pos = line_start(f, begin)
    f.seek(at)
    open_line: list[bytes] = []
    while pos < end:
        data = f.read(min(block, end - pos))
        if not data:
            return
        pos += len(data)
        *whole, rest = data.split(b"\n")
        for i, line in enumerate(whole):
            if i == 0 and open_line:
                line = b"".join([*open_line, line])
                open_line = []
            yield at, line
            at += len(line) + 1
        open_line.append(rest)


def line_batches(filesystem, ranges) -> Iterator:
    """Arrow batches of the lines in ``ranges`` (path to open, file's name, begin, end)."""
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_pydict({
            "line": [line.decode("utf-8", "replace") for _, _, line in rows], "source_file": [name for name, _, _ in rows],
            "file_block_start": pa.array([0] * len(rows), pa.int64()),
            "line_seq": pa.array([at for _, at, _ in rows], pa.int64())})

    rows, size = [], 0
    for path, name, begin, end in ranges:
        with filesystem.open_input_file(path) as f:
            for at, line in appended_lines(f, begin, end):
                rows.append((name, at, line))
                size += len(line)
                if len(rows) >= ROWS or size >= BLOCK:
                    yield batch(rows)
                    rows, size = [], 0
    if rows:
        yield batch(rows)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.restart = options["path"], options.get("truncated", "fail") == "restart"
        self.split = int(options.get("split", SPLIT))

    def _filesystem(self):
        from pyarrow import fs
        filesystem, base = fs.FileSystem.from_uri(self.root)
        scheme = self.root.split("://")[0] + "://" if "://" in self.root and not self.root.startswith("file:") else ""
        return fs, filesystem, base, scheme

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, filesystem, base, _ = self._filesystem()
        listed = filesystem.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
        return {f.path: f.size for f in listed if f.is_file and f.path.endswith(".jsonl")}

    def partitions(self, start: dict, end: dict) -> list[Task]:
        return in_tasks(split_appended(start, end, self.restart, self.split))

    def read(self, partition: Task):
        _, filesystem, _, scheme = self._filesystem()
        yield from line_batches(filesystem, ((part.path, scheme + part.path, part.begin, part.end) for part in partition.ranges))

    def commit(self, end: dict) -> None:
        pass


class GrowingLogs(DataSource):
    """Format ``growing_logs``; options ``path`` and ``truncated`` (fail, restart)."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return _LINES

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def growing_lines(spark: SparkSession, root: str, truncated: str = "fail", split: int = SPLIT) -> DataFrame:
    """Streaming lines with lineage, each once, of files below ``root`` that grow."""
    spark.dataSource.register(GrowingLogs)
    return (spark.readStream.format("growing_logs").option("path", root).option("truncated", truncated)
            .option("split", str(split)).load())


def grown_lines(spark: SparkSession, root: str, table: str, checkpoint: str, truncated: str = "fail", split: int = SPLIT) -> DataFrame:
    """``growing_lines`` of what is below ``root`` now, for queries that run over it
    and stop: tasks compare the files with the ends of their last ranges in ``table``
    and add a range for each that changed (empty for one that is gone); the stream
    reads that table.  ``checkpoint`` is the query's: one begun over ``growing_lines``
    goes on with it."""
    from meterline.session import materialize_checkpoint
    uri = listable(spark, root)
    p, q = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (table, checkpoint))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not uri or (fs.exists(q) and not fs.exists(p)):
        return growing_lines(spark, root, truncated, split)
    fs.mkdirs(p)
    ranges = spark.read.schema(_RANGES).parquet(table)
    listing = ranges.agg(F.coalesce(F.max("listing") + 1, F.lit(0))).first()[0]
    known = ranges.groupBy("path").agg(F.max_by("end", "listing").alias("known"))
    files = list_all(spark, uri, hidden=True).where(F.col("path").endswith(".jsonl")).select("path", "length")
    size, before = F.coalesce("length", F.lit(0)), F.coalesce("known", F.lit(0))
    new = materialize_checkpoint(files.join(known, "path", "full").where(size != before).select(
        "path", F.lit(listing).cast("long").alias("listing"), F.when(size > before, before).otherwise(0).cast("long").alias("begin"),
        size.alias("end"), F.when(F.col("length") < before, before).alias("was")))
    shorter = new.where("was is not null").orderBy("path").first() if truncated != "restart" else None
    if shorter:
        raise ValueError(f"{shorter.path} was {shorter.was} bytes long and is {shorter.end} now: truncated or replaced")
    n, total = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0))).first()
    if n:
        new.select("path", "listing", "begin", "end").write.mode("append").parquet(table)
    _, _, scheme = storage(uri)

    def read(batches):
        filesystem, _, _ = storage(uri)
        yield from line_batches(filesystem, ((path.removeprefix(scheme), path, begin, end) for b in batches
                                             for path, begin, end in zip(*(c.to_pylist() for c in b.columns))))

    found = spark.readStream.schema(_RANGES).option("recursiveFileLookup", "true").parquet(table).where("end > begin")
    parts = found.select("path", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(split).cast("long"))).alias("begin"), "end") \
        .select("path", "begin", F.least(F.col("begin") + split, "end").alias("end"))
    return parts.repartition(tasks_for(spark, n, total)).mapInArrow(read, _LINES)
