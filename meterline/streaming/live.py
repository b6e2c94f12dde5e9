"""Structured Streaming operators (O8.3-O8.10).

``stream_logs`` reads log files as they land, ``landed_lines`` what has landed
so far, listed and read in tasks (each file is immutable once
it is in the folder; a file grown in place is handled by the batch refresh
in ``meterline.streaming.refresh``).  The same narrow parser as the batch
path turns lines into entries; streaming adds event-time watermarks, keyed
de-duplication inside the watermark, incremental aggregates and a stateful
billing-block processor.

Every sink checkpoint lives under the shared ``spark.checkpoint.dir`` so a
restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.operators.common import nonempty
from meterline.session import checkpoint_dir
from meterline.sources.files import in_tasks, read_files, tasks_for
from meterline.sources.jsonl import ENTRY_COLS, JSONL_GLOB, file_manifest, materialize, parse_narrow, plain_path

MIN_REFRESH_SECONDS = 1
MAX_REFRESH_SECONDS = 60
LIVE_WINDOW = "24 hours"


def refresh_interval(seconds: float) -> str:
    """Trigger interval clamped to 1-60 s (O8.10)."""
    s = min(max(int(seconds), MIN_REFRESH_SECONDS), MAX_REFRESH_SECONDS)
    return f"{s} seconds"


def stream_lines(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw lines of ``*.jsonl`` files landing below ``root``, with lineage."""
    reader = (spark.readStream.format("text").option("recursiveFileLookup", "true").option("lineSep", "\n")
              .option("pathGlobFilter", JSONL_GLOB))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(root).select(
        F.col("value").alias("line"),
        plain_path(F.col("_metadata.file_path")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("file_block_start"))


def with_line_seq(batch: DataFrame) -> DataFrame:
    """A trigger's lines with their place in the split: the read order, as in the
    batch scan, unless the source tells it."""
    return batch if "line_seq" in batch.columns else batch.withColumn("line_seq", F.monotonically_increasing_id())


_FILES = "path string, modification_time timestamp, length long"


def landed_lines(spark: SparkSession, root: str, table: str, checkpoint: str, max_files_per_trigger: int | None = None,
                 max_bytes_per_trigger: int | None = None) -> DataFrame:
    """``stream_lines`` of what is below ``root`` now, for queries that run over
    it and stop: the files not yet in ``table`` are added to it by tasks, oldest
    first, and the stream reads that table, which is small, instead of listing
    and keeping every log file on the driver.  A trigger takes one file of the
    table: at most ``max_files_per_trigger`` logs or about
    ``max_bytes_per_trigger`` bytes.  ``checkpoint`` is the query's: one begun
    over ``stream_lines`` goes on with it."""
    uri = in_tasks(spark, root)
    p, q = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (table, checkpoint))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not uri or (fs.exists(q) and not fs.exists(p)):
        return stream_lines(spark, root, max_files_per_trigger)
    fs.mkdirs(p)
    known = spark.read.schema(_FILES).parquet(table).select("path")
    new = materialize(file_manifest(spark, uri).join(known, "path", "left_anti"))
    n, size = new.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(1, -(-size // max_bytes_per_trigger)) if max_bytes_per_trigger else 1
    if n:
        new.select("path", "modification_time", "length").repartitionByRange(parts, "modification_time", "path") \
            .sortWithinPartitions("modification_time", "path").write.option("maxRecordsPerFile", str(max_files_per_trigger or 0)) \
            .mode("append").parquet(table)
    listed = spark.readStream.schema(_FILES).option("recursiveFileLookup", "true")
    if max_files_per_trigger or max_bytes_per_trigger:
        listed = listed.option("maxFilesPerTrigger", "1")
    return read_files(listed.parquet(table), uri, tasks_for(spark, min(n, max_files_per_trigger or n) // parts, size // parts))


def live_reports(spark: SparkSession, root: str, name: str, reports: dict, prices: DataFrame | None = None,
                 max_files_per_trigger: int | None = None) -> dict[str, DataFrame]:
    """Reports over everything landed so far, refreshed on every trigger, equal
    to the batch reports whatever the triggers (O8.4, O8.6-O8.9).

    A trigger parses its new lines into a folder of its own, then runs the
    batch dedup, pricing and ``reports`` (name -> function of the priced
    entries) over all parsed lines: which copy of a call counts is decided in
    load order, not in order of arrival.  Every folder is named by the
    trigger's number and overwritten, so a retried trigger writes the same
    files again; the checkpoint is kept under ``name``, so a restarted run
    goes on where it stopped.  Runs until nothing new is there and returns the
    last trigger's reports.
    """
    from meterline.sources.jsonl import finish_usage
    base = checkpoint_dir(spark).rstrip("/") + f"/meterline-streams/{name}"

    def each(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        parsed = parse_narrow(with_line_seq(batch))
        parsed.write.mode("overwrite").parquet(f"{base}/parsed/epoch={epoch}")
        entries = finish_usage(session.read.parquet(f"{base}/parsed").drop("epoch"), prices)["entries"]
        for report, fn in reports.items():
            fn(entries).write.mode("overwrite").parquet(f"{base}/reports/{report}/epoch={epoch}")

    q = (landed_lines(spark, root, f"{base}/files", f"{base}/_checkpoint", max_files_per_trigger).writeStream
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).foreachBatch(each).start())
    q.awaitTermination()

    def latest(report: str) -> DataFrame:
        out = spark.read.parquet(f"{base}/reports/{report}")
        return out.where(F.col("epoch") == out.agg(F.max("epoch")).scalar()).drop("epoch")

    return {report: latest(report) for report in reports}


def stream_logs(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming USAGE_ENTRY rows (before dedup) from ``*.jsonl`` files
    landing below ``root`` (O8.3).  Load order inside the stream is the
    arrival order, so ``file_first_ts`` is NULL."""
    lines = stream_lines(spark, root, max_files_per_trigger)
    parsed = parse_narrow(lines.withColumn("line_seq", F.lit(0).cast("bigint")))
    return (parsed.where(F.col("kind") == "entry")
            .withColumn("file_first_ts", F.lit(None).cast("timestamp"))
            .select(*ENTRY_COLS))


def stream_dedup(sdf: DataFrame, delay: str = LIVE_WINDOW) -> DataFrame:
    """Drop repeated (message_id, request_id) inside the watermark delay;
    rows missing either key pass through (O8.5).  The copy that arrives first
    stays; ``stateful.keep_first`` keeps the one that is first in load order."""
    keyed = F.coalesce(nonempty("message_id") & nonempty("request_id"), F.lit(False))
    w = sdf.withWatermark("ts", delay)
    first = w.where(keyed).dropDuplicatesWithinWatermark(["message_id", "request_id"])
    return first.unionByName(w.where(~keyed))


def run_available_now(sdf: DataFrame, name: str, output_mode: str = "append",
                      fmt: str = "parquet") -> DataFrame:
    """Run a streaming frame over everything available, then stop; return the
    sink table.  Sink and checkpoint live under the shared checkpoint folder
    (O8.10 trigger ``availableNow``)."""
    spark = sdf.sparkSession
    base = checkpoint_dir(spark).rstrip("/") + f"/meterline-streams/{name}-{uuid.uuid4().hex[:8]}"
    writer = sdf.writeStream.option("checkpointLocation", base + "/_checkpoint").trigger(availableNow=True)
    if output_mode == "append":
        q = writer.outputMode("append").format(fmt).option("path", base + "/out").start()
        q.awaitTermination()
        return spark.read.format(fmt).load(base + "/out")

    def sink(batch: DataFrame, epoch: int) -> None:
        # one folder per trigger: a retried trigger overwrites its own rows
        batch.write.mode("overwrite").format(fmt).save(f"{base}/out/_epoch={epoch}")

    q = writer.outputMode(output_mode).foreachBatch(sink).start()
    q.awaitTermination()
    out = _written(spark, base + "/out", sdf.schema, fmt)
    if output_mode == "complete":
        last = out.agg(F.max("_epoch").alias("_m"))
        out = out.join(last, out["_epoch"] == last["_m"], "left_semi")
    return out.drop("_epoch")


def _written(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """What the triggers wrote below ``path``, with ``_epoch``; no rows of
    ``schema`` when none has written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.format(fmt).load(path)
    return spark.createDataFrame([], schema.add("_epoch", "int"))


def live_block_metrics(blocks: DataFrame, hours: int, as_of, token_limit: int) -> DataFrame:
    """Burn rate, projection, limit status and live labels of the open blocks
    (O8.8, applying O5.6-O5.10 to each trigger's block table)."""
    from meterline.operators.blocks import (with_active_flag, with_burn_rate, with_limit_status,
                                            with_live_status, with_projection)
    b = with_active_flag(blocks, hours, as_of)
    b = with_projection(with_burn_rate(b), as_of)
    b = with_limit_status(b, token_limit)
    return with_live_status(b, token_limit)


def run_live(sdf: DataFrame, name: str, sink, refresh_seconds: float = 5, output_mode: str = "update"):
    """Start a long-running live query refreshing every ``refresh_seconds``
    (clamped to 1-60 s, O8.10).  ``sink`` is a ``foreachBatch`` function.  The
    checkpoint lives under ``spark.checkpoint.dir``, so a restarted query
    resumes; the caller stops the returned query."""
    base = checkpoint_dir(sdf.sparkSession).rstrip("/") + f"/meterline-streams/{name}"
    return (sdf.writeStream.outputMode(output_mode).option("checkpointLocation", base + "/_checkpoint")
            .trigger(processingTime=refresh_interval(refresh_seconds)).foreachBatch(sink).start())
