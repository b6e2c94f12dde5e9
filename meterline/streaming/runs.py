"""A log of mergeable rows in runs (O8.6).

Every trigger writes its rows as a run of its own.  Before that, as often as the
last ``FANOUT`` runs are of one size class, they are merged into one, so a row is
rewritten once per class: after N triggers at most ``FANOUT`` runs of each of
log N classes are there, and a trigger costs its own rows and, on average, log N
times that in merges, never the history.

A run is the folder ``run-<first trigger>-<last trigger>`` with a ``_SUCCESS``
file; runs inside a wider one no longer count.  A retried trigger writes its own
run again, and only runs of earlier triggers are merged, so a lost executor or
driver at any moment leaves a readable log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8
BUCKETS = 32
_PLACE = "run string, bucket int"


class RunLog:
    mark = "run-"

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/{self.mark}{run[0]}-{run[1]}"

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _whole(self) -> list[tuple[int, int]]:
        """Every finished run; their number is logarithmic in the triggers."""
        p, fs = self._fs()
        if not fs.exists(p):
            return []
        found = []
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            if name.startswith(self.mark) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                first, last = name.removeprefix(self.mark).split("-")
                found.append((int(first), int(last)))
        return found

    def runs(self) -> list[tuple[int, int]]:
        """The runs that count, oldest first."""
        out: list[tuple[int, int]] = []
        for run in sorted(self._whole(), key=lambda r: (r[0], -r[1])):
            if not out or run[1] > out[-1][1]:
                out.append(run)
        return out

    def _load(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self._folder, runs))

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, merged; with ``before`` those of earlier triggers."""
        return self.merge(self._load([r for r in self.runs() if before is None or r[1] < before]))

    def add(self, rows: DataFrame, epoch: int) -> None:
        """The merged ``rows`` of trigger ``epoch``."""
        self._compact(epoch)
        self._write(rows, (epoch, epoch))

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        self.merge(rows).write.mode("overwrite").parquet(self._folder(run))

    def _compact(self, epoch: int) -> None:
        while True:
            runs = [r for r in self.runs() if r[1] < epoch]
            last = runs[-FANOUT:]
            if len(last) < FANOUT or len({self._size_class(r) for r in last}) > 1:
                return
            wide = (last[0][0], last[-1][1])
            self._write(self._load(last), wide)
            # what an earlier merge replaced; the runs just merged stay for readers of this moment
            _, fs = self._fs()
            for r in self._whole():
                if r not in last and r != wide and any(w[0] <= r[0] and r[1] <= w[1] for w in runs if w != r):
                    fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(r)), True)

    @staticmethod
    def _size_class(run: tuple[int, int]) -> int:
        width, level = run[1] - run[0] + 1, 0
        while width >= FANOUT:
            width, level = width // FANOUT, level + 1
        return level


def bucket(key: str = "key") -> Column:
    """The folder of a key; ``repartition(BUCKETS, key)`` deals rows out the same way."""
    return F.pmod(F.hash(key), F.lit(BUCKETS)).cast("int")


def write_by_key(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows in ``BUCKETS`` folders by the hash of their ``key``."""
    rows.withColumn("bucket", bucket()).sortWithinPartitions("bucket", "key").write.mode(mode).partitionBy("bucket").parquet(path)


def of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of ``rows`` written by :func:`write_by_key` whose key is in ``keys``;
    folders without such a key are not read."""
    there = [r.bucket for r in keys.select(bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS
    wanted = keys.select(F.col("key").alias("_key"))
    return rows.where(F.col("bucket").isin(there)).join(wanted, F.col("key").eqNullSafe(F.col("_key")), "left_semi")


class KeyedLog(RunLog):
    """A run log of rows with a ``key``, laid out by it: the rows of some keys are
    read without the folders of others.  ``live`` (rows, epoch) leaves out, where
    runs are merged or read, what is forgotten before that trigger."""

    mark = "run="  # a column, as the folders by key are

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame],
                 live: Callable[[DataFrame, int], DataFrame] = lambda rows, epoch: rows):
        super().__init__(spark, path, schema, merge)
        self.live = live

    def _load(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], f"{self.schema}, {_PLACE}")
        return self.spark.read.schema(f"{self.schema}, {_PLACE}").option("basePath", self.path).parquet(*map(self._folder, runs))

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        if run[0] != run[1]:
            rows = self.live(rows, run[1] + 1)
        write_by_key(self.merge(rows.drop("run", "bucket").repartition(BUCKETS, "key")), self._folder(run))

    def begun(self, epoch: int) -> bool:
        """Whether there are runs of triggers before ``epoch``."""
        return any(r[1] < epoch for r in self.runs())

    def own(self, epoch: int) -> DataFrame:
        """The rows of trigger ``epoch``."""
        return self._load([(epoch, epoch)]).drop("run", "bucket")

    def read_keys(self, keys: DataFrame, before: int) -> DataFrame:
        """The rows of ``keys`` of triggers before ``before``, merged."""
        rows = self._load([r for r in self.runs() if r[1] < before])
        return self.merge(self.live(of_keys(rows, keys).drop("run", "bucket"), before))
