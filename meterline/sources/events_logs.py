"""Usage logs in the reference's JSONL layout, derived from ``events``.

Every event becomes one usage line in ``<root>/projects/p<u%10>/s<u>.jsonl``
(or a sub-agent file), signup and error events also a session-name line,
and a share of events an extra line that must be rejected.  The lines of a
file are in event-time order, so a file's load order (its earliest
timestamp) is the earliest event time of the file.  The work grows with
``events``: the whole table is written.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import checkpoint_dir
from meterline.sinks.jsonl import exists, touch, write_jsonl
from meterline.sources.events_view import usage_view

LOG_PREFIX = "/data/projects/"
# extra lines: event_id % m == 0 -> kind of bad line
MALFORMED_EVERY = 13
STRING_TOKENS_EVERY = 17
USER_LINE_EVERY = 19


def _rfc3339(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def usage_log_lines(spark: SparkSession, sf_dir: str, replicas: int = 1) -> DataFrame:
    """``(rel_path, ts, line_seq, kind, line)`` for every log line.

    ``replicas`` > 1 repeats every event that many times inside the same
    files, with replica-specific entry and message ids (a larger log set for
    throughput measurements; replica 0 is the plain set).
    """
    u = usage_view(spark, sf_dir).withColumn(
        "rel_path", F.concat(F.lit("projects/"), F.substring_index(F.col("source_file"), LOG_PREFIX, -1)))
    if replicas > 1:
        rep = F.col("_rep")
        u = (u.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
             .withColumns({"entry_id": F.when(rep == 0, F.col("entry_id"))
                                        .otherwise(F.concat_ws("-", "entry_id", rep.cast("string"))),
                           "message_id": F.when(rep == 0, F.col("message_id"))
                                          .otherwise(F.concat_ws("-r", "message_id", rep.cast("string"))),
                           "line_seq": F.col("line_seq") * replicas + rep})
             .drop("_rep"))
    usage = u.select(
        "rel_path", "ts", "line_seq", F.lit(0).alias("kind"),
        F.to_json(F.struct(
            F.col("entry_id").alias("id"),
            _rfc3339("ts").alias("timestamp"),
            F.col("session_id").alias("sessionId"),
            F.col("request_id").alias("requestId"),
            F.col("project_path").alias("project_path"),
            F.col("block_type").alias("block_type"),
            F.when(F.col("logged_cost") != 0, F.col("logged_cost")).alias("costUSD"),
            F.struct(F.col("message_id").alias("id"), F.col("model").alias("model"),
                     F.struct(F.col("input_tokens").alias("input_tokens"),
                              F.col("output_tokens").alias("output_tokens"),
                              F.col("cache_create_tokens").alias("cache_creation_input_tokens"),
                              F.col("cache_read_tokens").alias("cache_read_input_tokens")).alias("usage")
                     ).alias("message"))).alias("line"))
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    named = u.join(ev.withColumnRenamed("event_id", "_eid"),
                   F.col("_eid") == (F.floor(F.col("line_seq") / replicas) if replicas > 1 else F.col("line_seq"))
                   ).where(F.col("event_type").isin("signup", "error")).drop("_eid")
    names = named.select(
        "rel_path", "ts", "line_seq", F.lit(1).alias("kind"),
        F.when(F.col("event_type") == "signup", F.to_json(F.struct(
            F.lit("custom-title").alias("type"),
            F.concat(F.lit("title-"), F.col("line_seq").cast("string")).alias("customTitle"),
            F.col("session_id").alias("sessionId"))))
        .otherwise(F.to_json(F.struct(
            F.lit("agent-name").alias("type"),
            F.concat(F.lit("agent-"), F.col("line_seq").cast("string")).alias("agentName"),
            F.col("session_id").alias("sessionId")))).alias("line"))
    e = F.col("line_seq")
    bad = u.where((e % MALFORMED_EVERY == 0) | (e % STRING_TOKENS_EVERY == 0) | (e % USER_LINE_EVERY == 0)).select(
        "rel_path", "ts", "line_seq", F.lit(2).alias("kind"),
        F.when(e % MALFORMED_EVERY == 0, F.concat(F.lit("{bad json "), e.cast("string")))
        .when(e % STRING_TOKENS_EVERY == 0, F.concat(
            F.lit('{"timestamp":"'), _rfc3339("ts"),
            F.lit('","message":{"usage":{"input_tokens":"5","output_tokens":1}}}')))
        .otherwise(F.lit('{"type":"user","message":{"role":"user","content":"hi"}}')).alias("line"))
    return usage.unionByName(names).unionByName(bad)


def events_log_root(spark: SparkSession, sf_dir: str, replicas: int = 1) -> str:
    """Write (once per table set) and return the log root for ``sf_dir``.

    The files live under the shared ``spark.checkpoint.dir``; a marker file
    makes the write idempotent across runs and retries.
    """
    base = checkpoint_dir(spark).rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    st = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    tag = hashlib.sha1(f"{sf_dir}|{st.getLen()}|{st.getModificationTime()}|v1".encode()).hexdigest()[:12]
    suffix = f"-x{replicas}" if replicas > 1 else ""
    root = f"{base}/meterline-logs/{os.path.basename(sf_dir.rstrip('/'))}-{tag}{suffix}"
    if not exists(root, "_DONE"):
        write_jsonl(usage_log_lines(spark, sf_dir, replicas), root, order=["ts", "line_seq", "kind"])
        touch(root, "_DONE")
    return root
