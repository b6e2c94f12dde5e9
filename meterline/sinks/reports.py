"""Report sinks (O10.1-O10.8).

Each ``*_rows`` function returns the exact export rows as a DataFrame of
strings/numbers (the column order and formatting of the reference's CSV
exports); ``write_csv`` / ``write_json`` write any of them with Spark's
writers, so an export is as parallel as the report it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators.common import money_out

RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _ts(c) -> F.Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, RFC3339)


def _fixed(c, places: int) -> F.Column:
    """Decimal text with exactly ``places`` decimals (half-up on the exact value)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x.cast("decimal(38,12)"), places).cast(f"decimal(38,{places})").cast("string")


def entries_csv_rows(entries: DataFrame) -> DataFrame:
    """9 columns: timestamp, model, project_path, input_tokens, output_tokens,
    total_tokens, cost (6 decimals), session_id, block_type (O10.1)."""
    return entries.select(
        _ts("ts").alias("timestamp"), F.coalesce("model", F.lit("")).alias("model"),
        F.coalesce("project_path", F.lit("")).alias("project_path"), "input_tokens", "output_tokens",
        "total_tokens", _fixed("cost", 6).alias("cost"), F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.coalesce("block_type", F.lit("")).alias("block_type"))


def sessions_csv_rows(sessions: DataFrame) -> DataFrame:
    """13 columns; id lists joined by ';', duration in whole seconds (O10.2).
    ``sessions`` is ``session_report(..., with_lists=True)``."""
    return sessions.select(
        F.col("project_path").alias("session_id"), "session_name",
        F.array_join("session_ids", ";").alias("session_ids"),
        F.array_join("source_files", ";").alias("source_files"),
        _ts("start_time").alias("start_time"), _ts("end_time").alias("end_time"),
        F.round(F.col("duration_seconds"), 0).cast("bigint").alias("duration_seconds"),
        _fixed("total_cost", 6).alias("total_cost"), _fixed("cache_create_cost", 6).alias("cache_create_cost"),
        _fixed("cache_read_cost", 6).alias("cache_read_cost"), "total_tokens", "request_count", "project_path")


def block_types_csv_rows(block_types: DataFrame) -> DataFrame:
    """6 columns (O10.3)."""
    return block_types.select("block_type", "count", "total_tokens", _fixed("total_cost", 6).alias("total_cost"),
                              _ts("first_seen").alias("first_seen"), _ts("last_seen").alias("last_seen"))


def blocks_csv_rows(blocks: DataFrame) -> DataFrame:
    """13 columns, cost with 2 decimals (O10.4)."""
    return blocks.select(
        F.col("block_id").alias("Block ID"), _ts("start_time").alias("Start Time"),
        _ts("end_time").alias("End Time"), F.lower(F.col("is_active").cast("string")).alias("Is Active"),
        F.lower(F.col("is_gap").cast("string")).alias("Is Gap"),
        F.col("input_tokens").alias("Input Tokens"), F.col("output_tokens").alias("Output Tokens"),
        F.col("cache_creation_input_tokens").alias("Cache Creation Tokens"),
        F.col("cache_read_input_tokens").alias("Cache Read Tokens"), F.col("total_tokens").alias("Total Tokens"),
        _fixed("cost_usd", 2).alias("Cost (USD)"), F.array_join("models", ";").alias("Models"),
        F.col("entry_count").alias("Entry Count"))


def blocks_json_rows(blocks: DataFrame) -> DataFrame:
    """Blocks with nested token counts, burn rate, projection and token-limit
    status (O10.7); expects ``with_limit_status`` output."""
    return blocks.select(
        F.col("block_id").alias("id"), "start_time", "end_time", "actual_end_time", "is_active", "is_gap",
        F.col("entry_count").alias("entries"),
        F.struct("input_tokens", "output_tokens", "cache_creation_input_tokens",
                 "cache_read_input_tokens").alias("token_counts"),
        "total_tokens", money_out("cost_usd").alias("cost_usd"), "models",
        F.when(F.col("tokens_per_minute").isNotNull(), F.struct(
            "tokens_per_minute", "tokens_per_minute_for_indicator", "cost_per_hour")).alias("burn_rate"),
        F.when(F.col("projected_total_tokens").isNotNull(), F.struct(
            F.col("projected_total_tokens").alias("total_tokens"), F.col("projected_total_cost").alias("total_cost"),
            F.col("remaining_minutes").alias("remaining_minutes"))).alias("projection"),
        F.when(F.col("limit_status").isNotNull(), F.struct(
            F.col("token_limit").alias("limit"), F.col("projected_total_tokens").alias("projected_usage"),
            F.col("projected_percent").alias("percent_used"), F.col("limit_status").alias("status")))
        .alias("token_limit_status"),
        "usage_limit_reset_time")


def report_json_rows(summary: DataFrame) -> DataFrame:
    """Period report document: period, bounds, totals and the summary
    (O10.5).  The entries of the period are written next to it as JSON
    lines (``write_report_json``) instead of one array in one document."""
    return summary.select(
        "period", "start_time", "end_time", "total_cost", "total_tokens",
        F.struct("total_requests", "total_cost", "total_tokens", "input_tokens", "output_tokens", "models",
                 "projects", "average_cost").alias("summary"))


def write_csv(rows: DataFrame, path: str, single_file: bool = False) -> None:
    out = rows.coalesce(1) if single_file else rows
    out.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report_json(summary: DataFrame, entries: DataFrame, path: str) -> None:
    write_json(report_json_rows(summary), f"{path}/report")
    write_json(entries, f"{path}/entries")


def write_usage_table(entries: DataFrame, path: str) -> None:
    """Priced entries as parquet partitioned by ``date_key`` (O10.8): later
    reports filtered on days read only those partitions.  Rows are rebalanced by
    day: AQE splits a day that holds a third of the rows by its measured size
    and joins small ones."""
    entries.hint("rebalance", "date_key").write.mode("overwrite").partitionBy("date_key").parquet(path)
