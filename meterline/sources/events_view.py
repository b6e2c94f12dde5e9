"""Usage facts derived from the driver's ``events`` table.

The projection below is the bridge between the parquet test tables and the
usage-log data model (see FIXTURES.md section 5).  It is a narrow map over
``events`` with no shuffle: column pruning and predicate pushdown reach the
parquet scan.  It carries duplicates, un-keyed rows, unknown models, missing
cache tokens and logged costs on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.schema import MONEY

# Load order of the events view: the event time, then the event id.
VIEW_ORDER = ["ts", "line_seq"]

# fixed values: event type -> model id of the view
VIEW_MODELS = {
    "view": "claude-3-5-sonnet-20241022",
    "click": "claude-3-haiku-20240307",
    "purchase": "claude-3-opus-20240229",
    "error": "gpt-4o",
    "signup": "unknown-model-x",
}
VIEW_BLOCK_TYPES = ["code", "text", "analysis"]


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source_file(project: F.Column, session: F.Column, event_id: F.Column) -> F.Column:
    return F.when(event_id % 7 == 0,
                  F.concat(project, F.lit("/"), session, F.lit("/subagents/agent-"),
                           (event_id % 3).cast("string"), F.lit(".jsonl"))
                  ).otherwise(F.concat(project, F.lit("/"), session, F.lit(".jsonl")))


def usage_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USAGE_ENTRY rows, one per event (before dedup)."""
    ev = load_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    model_map = F.create_map(*[F.lit(x) for kv in VIEW_MODELS.items() for x in kv])
    uid = F.col("user_id").cast("string")
    project = F.concat(F.lit("/data/projects/p"), (F.col("user_id") % 10).cast("string"))
    session = F.concat(F.lit("s"), uid)
    cache_cc = F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(k * 20)
    cache_cr = F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(k * 100)
    inp = F.floor(F.col("value") * 10).cast("bigint")
    out = F.floor(F.col("value") * 3).cast("bigint")
    logged = F.when(F.col("event_id") % 10 == 0,
                    (F.floor("value").cast("bigint").cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)"))
                    ).otherwise(F.lit(0)).cast(MONEY)
    btype = F.element_at(F.array(*[F.lit(b) for b in VIEW_BLOCK_TYPES]),
                         (F.col("event_id") % 4 + 1).cast("int"))
    ts = F.col("ts").cast("timestamp")
    return ev.select(
        F.col("event_id").cast("string").alias("entry_id"),
        ts.alias("ts"),
        project.alias("project_path"),
        F.element_at(model_map, F.col("event_type")).alias("model"),
        inp.alias("input_tokens"),
        out.alias("output_tokens"),
        cache_cc.cast("bigint").alias("cache_create_tokens"),
        cache_cr.cast("bigint").alias("cache_read_tokens"),
        (inp + out + F.coalesce(cache_cc, F.lit(0)) + F.coalesce(cache_cr, F.lit(0))).cast("bigint")
        .alias("total_tokens"),
        logged.alias("logged_cost"),
        session.alias("session_id"),
        F.when(F.col("event_id") % 4 < 3, btype).alias("block_type"),
        F.concat_ws("-", F.lit("m"), uid, F.col("event_type"),
                    F.to_date(ts).cast("string")).alias("message_id"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("r-"), uid)).alias("request_id"),
        F.lit(None).cast("string").alias("usage_limit_reset_time"),
        _source_file(project, session, F.col("event_id")).alias("source_file"),
        F.lit(None).cast("timestamp").alias("file_first_ts"),
        F.lit(0).cast("bigint").alias("file_block_start"),
        F.col("event_id").alias("line_seq"),
    )


def usage_name_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-name lines of the view: a custom title for each signup event,
    an agent name for each error event.  ``file_first_ts`` is the earliest
    event time of the line's file, the view's file load order."""
    ev = load_table(spark, sf_dir, "events")
    project = F.concat(F.lit("/data/projects/p"), (F.col("user_id") % 10).cast("string"))
    session = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    with_file = ev.select(
        F.col("event_id"), F.col("event_type"), F.col("ts").cast("timestamp").alias("ts"),
        session.alias("session_id"),
        _source_file(project, session, F.col("event_id")).alias("source_file"))
    file_first = with_file.groupBy("source_file").agg(F.min("ts").alias("file_first_ts"))
    names = with_file.where(F.col("event_type").isin("signup", "error")).select(
        "session_id",
        F.when(F.col("event_type") == "signup", F.lit("title")).otherwise(F.lit("agent")).alias("kind"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("title-"), F.col("event_id").cast("string")))
        .otherwise(F.concat(F.lit("agent-"), F.col("event_id").cast("string"))).alias("name"),
        "source_file", "ts", F.lit(0).cast("bigint").alias("file_block_start"),
        F.col("event_id").alias("line_seq"))
    # one row per file: the join side is bounded by the number of files
    return names.join(file_first, "source_file", "left")
