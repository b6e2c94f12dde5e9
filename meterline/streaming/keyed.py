"""Views kept per key over a stream of signed rows (O8.7, O8.9).

A trigger writes its signed rows, added up, as a run laid out by key
(``runs.KeyedLog``).  For the keys it touches, what the view shows is derived
anew from all their rows by built-in expressions, compared with what was sent
before, and the difference is written as the trigger's rows.  No row passes
through Python; of the runs and of the rows sent before, a trigger reads the
folders its keys fall in and no other.

Everything a trigger reads is of triggers before it, and what it writes is in
folders named by its number: a retried trigger writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import session_conf
from meterline.streaming.runs import BUCKETS, KeyedLog, of_keys, write_by_key


class KeyedView:
    """``derive`` gives from the rows of whole keys the view's rows, at most one per
    ``key`` and ``start_us``; ``schema`` is theirs.  One that is no more is sent with
    the values ``gone``.  ``shown`` tells which of the rows sent are there: the last
    one of its place counts, if its column ``count`` is not 0."""

    def __init__(self, spark: SparkSession, path: str, log: KeyedLog, schema: str, derive: Callable[[DataFrame], DataFrame],
                 gone: dict[str, Column], count: str, shown: str = "true"):
        self.spark, self.path, self.log, self.schema, self.derive = spark, path, log, schema, derive
        self.gone, self.count, self.shown = gone, count, shown

    def sent(self) -> DataFrame:
        """The rows of all triggers, with ``epoch``."""
        return self.spark.read.schema(self.schema + ", epoch long, bucket int").parquet(self.path)

    def add(self, rows: DataFrame, epoch: int, beside: DataFrame | None = None,
            keep: Callable[[DataFrame], DataFrame] = lambda changed: changed) -> None:
        """The signed ``rows`` of trigger ``epoch``.  ``beside`` are rows sent as they
        are; ``keep`` chooses among the changed ones, of which ``_gone`` are no more."""
        self.log.add(rows, epoch)
        # as many partitions as folders: a task that derives rows of a folder writes them
        with session_conf(self.spark, spark__sql__shuffle__partitions=str(BUCKETS)):
            out = keep(self._changed(epoch)).drop("_gone")
            write_by_key(out if beside is None else out.unionByName(beside), f"{self.path}/epoch={epoch}")

    def touched(self, epoch: int) -> DataFrame:
        return self.log.own(epoch).select("key").distinct()

    def now(self, epoch: int) -> DataFrame:
        """What the view shows, after trigger ``epoch``, of the keys it touches."""
        rows = self.log.own(epoch)
        if self.log.begun(epoch):
            rows = self.log.merge(rows.unionByName(self.log.read_keys(self.touched(epoch), epoch)))
        return self.derive(rows)

    def _changed(self, epoch: int) -> DataFrame:
        now = self.now(epoch)
        if not self.log.begun(epoch):
            return now.withColumn("_gone", F.lit(False))
        place, values = ["key", "start_us"], [c for c in now.columns if c not in ("key", "start_us")]
        sent = of_keys(self.sent().where((F.col("epoch") < epoch) & F.expr(self.shown)), self.touched(epoch))
        was = sent.groupBy(*place).agg(F.max_by(F.struct(*values), "epoch").alias("was")).where(F.col("was")[self.count] != 0)
        both = now.select(*place, F.struct(*values).alias("now")).unionByName(was, allowMissingColumns=True)
        one = both.repartition(BUCKETS, "key").groupBy(*place).agg(F.max("now").alias("now"), F.max("was").alias("was"))
        gone = F.col("now").isNull()
        return one.where(~F.col("now").eqNullSafe(F.col("was"))).select(
            *place, *[F.when(gone, self.gone[c]).otherwise(F.col("now")[c]).alias(c) for c in values], gone.alias("_gone"))
