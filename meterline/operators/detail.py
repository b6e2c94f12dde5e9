"""Session -> source-file detail (O3.6) and block time fields (O9.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.labels import is_real_model, model_label, project_label, short_file_label
from meterline.functions.timefns import local_time, minutes_between
from meterline.operators.common import money_out, nonempty, order_struct, sum0
from meterline.schema import LOAD_ORDER


def session_file_detail(df: DataFrame, tz: str = "UTC", order: list[str] = LOAD_ORDER) -> DataFrame:
    """One row per (project "session", source file) with the file's measures
    and the session's display name (O3.6).

    The match is an equi-grouping on (project, file), so no per-session file
    list is ever collected.  A project whose entries carry no file gets one
    row with ``file_path`` NULL and ``all_files_fallback`` true, where the
    reference lists every file of the report (a cross product this library
    does not materialise; the full file report is ``source_file_report``).
    """
    project = F.coalesce(F.when(F.col("project_path") != "", F.col("project_path")), F.lit("unknown"))
    named = F.when(nonempty("session_name"), F.struct(F.col("ts").alias("ts"), order_struct(order).alias("o"),
                                                      F.col("session_name").alias("name")))
    x = df.withColumn("_project", project)
    names = x.groupBy("_project").agg(F.min(named).alias("_n"), F.count(F.when(nonempty("source_file"), 1))
                                      .alias("_files"))
    files = x.where(nonempty("source_file")).groupBy("_project", "source_file").agg(
        sum0("input_tokens").alias("input_tokens"), sum0("output_tokens").alias("output_tokens"),
        sum0("cache_create_tokens").alias("cache_create_tokens"), sum0("cache_read_tokens").alias("cache_read_tokens"),
        F.sum("api_cost").alias("api_cost"), F.sum("cache_create_cost").alias("cache_create_cost"),
        F.sum("cache_read_cost").alias("cache_read_cost"), F.sum("cost").alias("cost"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_real_model("model"), model_label("model")))), ";")
        .alias("models"),
        F.max("ts").alias("last_activity"))
    joined = names.join(files, "_project", "left")
    display = F.coalesce(F.col("_n.name"), project_label(F.col("_project")))
    return joined.select(
        F.col("_project").alias("project_path"), display.alias("session_display"),
        F.col("source_file").alias("file_path"), short_file_label("source_file").alias("file_label"),
        "models", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens",
        (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_create_tokens")
         + F.col("cache_read_tokens")).alias("total_tokens"),
        *[money_out(c).alias(c) for c in ["api_cost", "cache_create_cost", "cache_read_cost", "cost"]],
        F.date_format(local_time("last_activity", tz), "yyyy-MM-dd HH:mm").alias("last_activity"),
        (F.col("_files") == 0).alias("all_files_fallback"))


def block_time_fields(blocks: DataFrame, as_of=None) -> DataFrame:
    """Numeric parts of the block time label (O9.8): gap hours, span of a
    finished block, elapsed and remaining time of an active block."""
    now = F.lit(as_of).cast("timestamp") if as_of is not None else None
    span = minutes_between("actual_end_time", "start_time")
    out = blocks.withColumns({
        "gap_hours": F.when(F.col("is_gap"), F.floor(minutes_between("end_time", "start_time") / 60)),
        "span_hours": F.when(~F.col("is_gap"), F.floor(span / 60)),
        "span_minutes": F.when(~F.col("is_gap"), F.floor(span) % 60),
    })
    if now is not None:
        el = minutes_between(now, "start_time")
        rem = minutes_between("end_time", now)
        out = out.withColumns({
            "elapsed_hours": F.when(F.col("is_active"), F.floor(el / 60)),
            "elapsed_minutes_part": F.when(F.col("is_active"), F.floor(el) % 60),
            "remaining_hours": F.when(F.col("is_active"), F.floor(rem / 60)),
            "remaining_minutes_part": F.when(F.col("is_active"), F.floor(rem) % 60),
        })
    return out
