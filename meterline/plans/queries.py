"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (whole tables, no sampling) and runs the
library operators on the usage facts derived from them.  Arrays and maps are
shown joined into strings, the form the CSV export uses, so that the result
compares value by value with the DuckDB oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.operators import blocks as B
from meterline.operators import extras as X
from meterline.operators import reports as R
from meterline.operators.common import money_out
from meterline.operators.dedup import dedup_usage as _dedup
from meterline.operators.pricing import resolve_prices as _resolve
from meterline.plans.usage import joined, map_joined, priced_usage, view_names
from meterline.sources.events_view import VIEW_ORDER, usage_view

AS_OF = "2024-01-31 00:00:00"
REPORT_COLS = ["sessions", "models", "input_tokens", "output_tokens", "cache_create_tokens",
               "cache_read_tokens", "total_tokens", "api_cost", "cache_create_cost",
               "cache_read_cost", "cost"]


def _period(df: DataFrame, key: str, total: bool = False) -> DataFrame:
    cols = [key] + (["is_total"] if total else []) + REPORT_COLS
    return df.withColumn("models", joined("models")).select(*cols)


def q_daily_report(spark: SparkSession, sf: str) -> DataFrame:
    return _period(R.daily_report(priced_usage(spark, sf, names=False)), "date_key")


def q_daily_report_tz(spark: SparkSession, sf: str) -> DataFrame:
    return _period(R.daily_report(priced_usage(spark, sf, names=False), tz="America/New_York"), "date_key")


def q_daily_report_total(spark: SparkSession, sf: str) -> DataFrame:
    return _period(R.daily_report(priced_usage(spark, sf, names=False), with_total=True), "date_key", True)


def q_daily_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _period(R.daily_report(priced_usage(spark, sf, names=False), since="20240105",
                                  until="2024-01-20"), "date_key")


def q_monthly_report(spark: SparkSession, sf: str) -> DataFrame:
    return _period(R.monthly_report(priced_usage(spark, sf, names=False)), "month_key")


def q_monthly_report_total(spark: SparkSession, sf: str) -> DataFrame:
    return _period(R.monthly_report(priced_usage(spark, sf, names=False), tz="Asia/Tokyo", with_total=True),
                   "month_key", True)


def q_monthly_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _period(R.monthly_report(priced_usage(spark, sf, names=False), tz="Asia/Tokyo",
                                    since="2023-12", until="202401"), "month_key")


QUERIES = {
    "daily_report": q_daily_report,
    "daily_report_tz": q_daily_report_tz,
    "daily_report_total": q_daily_report_total,
    "daily_filtered": q_daily_filtered,
    "monthly_report": q_monthly_report,
    "monthly_report_total": q_monthly_report_total,
    "monthly_filtered": q_monthly_filtered,
}


# ---- facts: dedup, prices, costs, names -------------------------------------



def q_dedup_usage(spark, sf):
    return _dedup(usage_view(spark, sf), order=VIEW_ORDER).select(
        "entry_id", "message_id", "request_id", "ts", "session_id", "model", "input_tokens", "output_tokens")


def q_price_resolution(spark, sf):
    return _resolve(_dedup(usage_view(spark, sf), order=VIEW_ORDER)).select(
        "model", *[F.col(c).cast("double").alias(c) for c in
                   ["input_cost_per_token", "output_cost_per_token", "cache_creation_input_token_cost",
                    "cache_read_input_token_cost"]], "price_source")


def q_usage_costs(spark, sf):
    return priced_usage(spark, sf).select(
        "entry_id", "model", "session_name",
        *[money_out(c).alias(c) for c in ["api_cost", "cache_create_cost", "cache_read_cost", "cost"]])


def q_session_names(spark, sf):
    return view_names(spark, sf)


# ---- reports ---------------------------------------------------------------------

def q_period_summary(spark, sf):
    s = R.period_report(priced_usage(spark, sf, names=False), "daily", "2024-01-15")
    return s.withColumns({"models": map_joined("models"), "projects": map_joined("projects")})


def q_monthly_summary(spark, sf):
    s = R.period_report(priced_usage(spark, sf, names=False), "monthly", "2024-01")
    return s.withColumns({"models": map_joined("models"), "projects": map_joined("projects")})


def q_weekly_report(spark, sf):
    s = R.weekly_report(priced_usage(spark, sf, names=False), 2024, 2)
    return s.withColumns({"models": map_joined("models"), "projects": map_joined("projects")})


def q_weekly_report_all(spark, sf):
    s = R.weekly_report_all(priced_usage(spark, sf, names=False))
    return s.withColumns({"models": map_joined("models"), "projects": map_joined("projects")})


SESSION_COLS = ["project_path", "session_name", "start_time", "end_time", "duration_seconds", "last_activity",
                "request_count", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens",
                "total_tokens", "total_cost", "total_api_cost", "cache_create_cost", "cache_read_cost",
                "models_used", "n_session_ids", "n_source_files"]


def _sessions(df):
    return df.withColumn("models_used", joined("models_used")).select(*SESSION_COLS)


def q_session_report(spark, sf):
    return _sessions(R.session_report(priced_usage(spark, sf), order=VIEW_ORDER))


def q_session_members(spark, sf):
    return R.session_members(priced_usage(spark, sf, names=False))


def q_session_by_id(spark, sf):
    from meterline.operators.filters import filter_session_id
    return _sessions(R.session_report(filter_session_id(priced_usage(spark, sf), "s7"), order=VIEW_ORDER))


def q_session_by_name(spark, sf):
    from meterline.operators.filters import filter_session_name
    df = priced_usage(spark, sf)
    # the name of the session of user 3 (a name of the data, not a literal)
    name = view_names(spark, sf).where(F.col("session_id") == "s3").select("session_name").first()
    return _sessions(R.session_report(filter_session_name(df, name and name.session_name), order=VIEW_ORDER))


def q_user_price_costs(spark, sf):
    """Costs by model under a user price table made from ``part``: many rows
    per model id, of which the lowest prices count (O1.14, O3.4)."""
    import uuid
    from decimal import Decimal
    from meterline.operators.dedup import dedup_usage
    from meterline.operators.pricing import with_cost
    from meterline.session import checkpoint_dir
    from meterline.sources.events_view import load_table, usage_view
    from meterline.sources.prices import load_prices
    nano = F.lit(Decimal("0.000000001"))
    size, key = F.col("p_size").cast("decimal(10,0)"), (F.col("p_partkey") % 7).cast("decimal(10,0)")
    ids = F.array(*[F.lit(m) for m in ("claude-3-haiku-20240307", "gpt-4o", "unknown-model-x", "not-used")])
    made = load_table(spark, sf, "part").select(
        F.element_at(ids, (F.col("p_partkey") % 4 + 1).cast("int")).alias("model"),
        (size * nano).alias("input_cost_per_token"), (size * 2 * nano).alias("output_cost_per_token"),
        (key * nano).alias("cache_creation_input_token_cost"), ((key + 1) * nano).alias("cache_read_input_token_cost"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/meterline-prices/{uuid.uuid4().hex}"
    made.write.parquet(path)
    priced = with_cost(dedup_usage(usage_view(spark, sf), order=VIEW_ORDER), load_prices(spark, path, "parquet"))
    return priced.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), money_out(F.sum("cost")).alias("cost"))


def q_source_file_report(spark, sf):
    return R.source_file_report(priced_usage(spark, sf, names=False)).withColumn(
        "models_used", joined("models_used"))


def q_block_type_report(spark, sf):
    return R.block_type_report(priced_usage(spark, sf, names=False))


def q_usage_totals(spark, sf):
    return R.usage_totals(priced_usage(spark, sf, names=False))


def q_recent_entries(spark, sf):
    return R.recent_entries(priced_usage(spark, sf, names=False), 5).select(
        "entry_id", "ts", "model", "total_tokens", money_out("cost").alias("cost"))


# ---- labels ------------------------------------------------------------------------

def q_model_labels(spark, sf):
    from meterline.functions.labels import model_label
    return usage_view(spark, sf).select("model").distinct().select("model", model_label("model").alias("label"))


def q_file_labels(spark, sf):
    from meterline.functions.labels import short_file_label
    return usage_view(spark, sf).select("source_file").distinct().select(
        "source_file", short_file_label("source_file").alias("label"))


def label_paths(spark, sf):
    """Project paths of the view plus paths in six layouts built from the
    ``part`` table's names, types and brands, so every branch of the label
    rule is exercised by data of the test tables."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    dashed = F.regexp_replace("p_name", " ", "-")
    brand = F.regexp_replace("p_brand", "#", "")
    k = F.col("p_partkey") % 6
    path = (F.when(k == 0, F.concat(F.lit("/home/dev/.claude/projects/-Users-"), F.col("p_type"), F.lit("-"), dashed))
            .when(k == 1, F.concat(F.lit("/x/projects/-Volumes-DATA_"), (F.col("p_partkey") % 10).cast("string"),
                                   F.lit("-"), F.regexp_replace("p_name", " ", "_"), F.lit("_src-"), brand))
            .when(k == 2, F.concat(F.lit("/x/projects/-Users-bob-go_src-"), F.regexp_replace("p_name", " ", "")))
            .when(k == 3, F.concat(F.lit("/x/projects/-Users-bob-blog-"), dashed))
            .when(k == 4, F.concat(F.lit("/srv/"), F.col("p_type"), F.lit("/"), dashed, F.lit("/2024/01/05")))
            .otherwise(F.concat(F.lit("/x/projects/"), brand, F.lit("-"), F.upper(dashed), F.lit("-longsegmentname"))))
    return usage_view(spark, sf).select("project_path").unionByName(part.select(path.alias("project_path"))).distinct()


def q_project_labels(spark, sf):
    from meterline.functions.labels import project_label, project_short_name
    return label_paths(spark, sf).select(
        "project_path", project_label("project_path").alias("label"),
        project_short_name("project_path").alias("short_name"))


QUERIES.update({
    "dedup_usage": q_dedup_usage,
    "price_resolution": q_price_resolution,
    "usage_costs": q_usage_costs,
    "session_names": q_session_names,
    "period_summary": q_period_summary,
    "monthly_summary": q_monthly_summary,
    "weekly_report": q_weekly_report,
    "weekly_report_all": q_weekly_report_all,
    "session_report": q_session_report,
    "session_members": q_session_members,
    "session_by_id": q_session_by_id,
    "session_by_name": q_session_by_name,
    "user_price_costs": q_user_price_costs,
    "source_file_report": q_source_file_report,
    "block_type_report": q_block_type_report,
    "usage_totals": q_usage_totals,
    "recent_entries": q_recent_entries,
    "model_labels": q_model_labels,
    "file_labels": q_file_labels,
    "project_labels": q_project_labels,
})


# ---- billing blocks ----------------------------------------------------------------


BLOCK_COLS = ["block_id", "start_time", "end_time", "actual_end_time", "is_active", "is_gap", "entry_count",
              "input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens",
              "total_tokens", "cost_usd", "models"]


def _block_view(b, key):
    return b.withColumns({"cost_usd": money_out("cost_usd"), "models": joined("models")}).select(
        *([key] if key else []), *BLOCK_COLS)


def _facts(spark, sf):
    return priced_usage(spark, sf, names=False)


def q_block_assignment(spark, sf):
    return B.assign_blocks(_facts(spark, sf), 5, "session_id").select("entry_id", "session_id", "block_start")


def q_block_report(spark, sf):
    return _block_view(B.identify_blocks(_facts(spark, sf), 5, "session_id", AS_OF), "session_id")


def q_block_report_global(spark, sf):
    return _block_view(B.session_blocks(_facts(spark, sf), 5, None, AS_OF), None)


def q_block_gaps(spark, sf):
    b = B.identify_blocks(_facts(spark, sf), 5, "session_id", AS_OF)
    return B.gap_blocks(b, 5, "session_id").select("session_id", "block_id", "start_time", "end_time")


def q_active_blocks(spark, sf):
    from meterline.operators.filters import active_blocks
    return _block_view(active_blocks(B.identify_blocks(_facts(spark, sf), 5, "session_id", AS_OF)), "session_id")


def q_recent_blocks(spark, sf):
    from meterline.operators.filters import recent_blocks
    b = B.session_blocks(_facts(spark, sf), 5, "session_id", AS_OF)
    return _block_view(recent_blocks(b, AS_OF, 3), "session_id")


def q_block_burn_rate(spark, sf):
    b = B.with_burn_rate(B.identify_blocks(_facts(spark, sf), 5, None, AS_OF))
    mins = B.minutes_between("actual_end_time", "first_ts")
    return b.select("block_id", "tokens_per_minute", "tokens_per_minute_for_indicator",
                    F.when(mins > 0, money_out("cost_usd") / mins * 60).alias("cost_per_hour"))


def _projected(spark, sf):
    b = B.identify_blocks(_facts(spark, sf), 5, "session_id", AS_OF)
    return b, B.with_projection(B.with_burn_rate(b), AS_OF)


def q_block_projection(spark, sf):
    _, p = _projected(spark, sf)
    return p.where("is_active").select("session_id", "block_id", "remaining_minutes", "elapsed_minutes",
                                       "projected_total_tokens")


def q_block_limit_status(spark, sf):
    b, p = _projected(spark, sf)
    s = B.with_limit_status(p, "max", all_blocks=b)
    return s.select("session_id", "block_id", "is_active", "token_limit", "percent_of_limit", "remaining_tokens",
                    "projected_percent", "limit_status")


def q_block_live_status(spark, sf):
    _, p = _projected(spark, sf)
    s = B.with_live_status(p.where("is_active"), 50_000)
    return s.select("session_id", "block_id", "usage_percent", "burn_status", "usage_level", "projection_status")


def q_max_block_tokens(spark, sf):
    return B.max_block_tokens(B.identify_blocks(_facts(spark, sf), 5, "session_id", AS_OF))


def q_active_block_detail(spark, sf):
    d = B.active_block_detail(B.session_blocks(_facts(spark, sf), 5, "session_id", AS_OF), AS_OF,
                              key="session_id")
    return d.select("session_id", "block_id", "start_time", "end_time", "elapsed_minutes", "time_remaining_minutes",
                    "input_tokens", "output_tokens", "total_tokens", "cost_usd", "projected_total_tokens",
                    "token_limit", "remaining_tokens", "limit_status")


QUERIES.update({
    "block_assignment": q_block_assignment,
    "block_report": q_block_report,
    "block_report_global": q_block_report_global,
    "block_gaps": q_block_gaps,
    "active_blocks": q_active_blocks,
    "recent_blocks": q_recent_blocks,
    "block_burn_rate": q_block_burn_rate,
    "block_projection": q_block_projection,
    "block_limit_status": q_block_limit_status,
    "block_live_status": q_block_live_status,
    "max_block_tokens": q_max_block_tokens,
    "active_block_detail": q_active_block_detail,
})


# ---- JSONL logs written from events, read back through the log source ----------

def _jsonl(spark, sf):
    from meterline.sources.events_logs import events_log_root
    from meterline.sources.jsonl import load_usage
    return load_usage(spark, events_log_root(spark, sf))


def _rel(c):
    return F.concat(F.lit("projects/"), F.substring_index(F.col(c), "/projects/", -1))


def q_jsonl_ingest(spark, sf):
    return _period(R.daily_report(_jsonl(spark, sf)["entries"]), "date_key")


def q_jsonl_entries(spark, sf):
    e = _jsonl(spark, sf)["entries"]
    return e.select("entry_id", "session_name", _rel("source_file").alias("source_file"), "total_tokens",
                    money_out("cost").alias("cost"))


def q_jsonl_rejects(spark, sf):
    r = _jsonl(spark, sf)["rejects"]
    return r.groupBy("reject_reason", "counted").agg(F.count(F.lit(1)).alias("lines"))


def q_jsonl_session_names(spark, sf):
    return _jsonl(spark, sf)["names"]


def q_file_order(spark, sf):
    from meterline.sources.events_logs import events_log_root
    from meterline.sources.jsonl import parse_lines, scan_logs
    lines = scan_logs(spark, events_log_root(spark, sf))
    e = parse_lines(lines, "checkpoint")["entries"]
    return e.groupBy(_rel("source_file").alias("rel_path")).agg(F.min("file_first_ts").alias("file_first_ts"))


QUERIES.update({
    "jsonl_ingest": q_jsonl_ingest,
    "jsonl_entries": q_jsonl_entries,
    "jsonl_rejects": q_jsonl_rejects,
    "jsonl_session_names": q_jsonl_session_names,
    "file_order": q_file_order,
})


# ---- streaming over the same logs (availableNow, result read from the sink) ----

#: Live logs of this application by log folder: the first query of a view fills it, later ones go on from there.
_LIVE: dict[tuple, object] = {}
#: Bytes of logs a trigger; a fixed number of files would make triggers as many as small files ask for.
LIVE_TRIGGER_BYTES = 256 << 20


def _live(spark, sf, *views):
    """The stateful operators over the logs, landing in triggers sized by bytes,
    with ``views`` kept up to date; nothing of an earlier application is used."""
    from meterline.sources.events_logs import events_log_root
    from meterline.streaming.stateful import LiveLog
    root = events_log_root(spark, sf)
    name = _LIVE.setdefault((spark.sparkContext.applicationId, root), uuid.uuid4().hex)
    return LiveLog(spark, root, name, max_bytes_per_trigger=LIVE_TRIGGER_BYTES, views=views).advance()


def q_live_keep_first(spark, sf):
    cols = ["entry_id", "message_id", "request_id", "session_id", "source_file", "total_tokens"]
    return _live(spark, sf).kept(*cols).withColumn("source_file", _rel("source_file"))


def q_stream_daily(spark, sf):
    return _period(_live(spark, sf, "days").daily(), "date_key")


def q_stream_totals(spark, sf):
    return _live(spark, sf, "days").totals()


def q_stream_activity(spark, sf):
    return _live(spark, sf, "activity").activity()


def q_live_state_blocks(spark, sf):
    return _block_view(B.with_active_flag(_live(spark, sf, "blocks").blocks(), 5, AS_OF), "session_id")


def q_live_reports(spark, sf):
    """The batch daily report once per trigger over all parsed lines."""
    from meterline.sources.events_logs import events_log_root
    from meterline.streaming.live import live_reports
    root = events_log_root(spark, sf)
    out = live_reports(spark, root, uuid.uuid4().hex, {"daily": lambda e: _period(R.daily_report(e), "date_key")})
    return out["daily"]


QUERIES.update({
    "live_keep_first": q_live_keep_first,
    "live_state_blocks": q_live_state_blocks,
    "live_reports": q_live_reports,
    "stream_dedup": q_live_keep_first,
    "stream_daily": q_stream_daily,
    "stream_totals": q_stream_totals,
    "stream_activity": q_stream_activity,
    "stream_blocks": q_live_state_blocks,
})


# ---- incremental refresh: logs written in two phases into one folder ---------------

REFRESH_SPLIT = "2024-01-16 00:00:00"


def _two_phase_logs(spark, sf):
    """Write the first half of the month, load, then write everything (files
    grow in place and new files appear) and diff/refresh."""
    import uuid as _uuid
    from meterline.session import checkpoint_dir
    from meterline.sinks.jsonl import write_jsonl
    from meterline.sources.events_logs import usage_log_lines
    from meterline.streaming.refresh import load_state, manifest, manifest_diff
    root = checkpoint_dir(spark).rstrip("/") + f"/meterline-refresh/{_uuid.uuid4().hex[:8]}"
    lines = usage_log_lines(spark, sf)
    write_jsonl(lines.where(F.col("ts") < F.lit(REFRESH_SPLIT).cast("timestamp")), root,
                order=["ts", "line_seq", "kind"])
    state = load_state(spark, root)
    old_manifest = state["manifest"]
    write_jsonl(lines, root, order=["ts", "line_seq", "kind"])
    return root, state, old_manifest, manifest_diff, manifest


def q_incremental_refresh(spark, sf):
    from meterline.streaming.refresh import refresh
    root, state, _, _, _ = _two_phase_logs(spark, sf)
    out = refresh(spark, root, state)
    return _period(R.daily_report(out["entries"]), "date_key")


def q_refresh_by_keys(spark, sf):
    """First load with half of the month and copies of the agents' files that
    come first in load order; then the logs grow, the copies are deleted, and the
    store, opened anew, is refreshed by the keys this touches."""
    from meterline.session import checkpoint_dir
    from meterline.sinks.jsonl import write_jsonl
    from meterline.sources.events_logs import usage_log_lines
    from meterline.sources.files import delete_tree
    from meterline.streaming.store import UsageStore
    base = checkpoint_dir(spark).rstrip("/") + f"/meterline-refresh/{uuid.uuid4().hex[:8]}"
    root = base + "/logs"
    lines = usage_log_lines(spark, sf)
    first = lines.where(F.col("ts") < F.lit(REFRESH_SPLIT).cast("timestamp"))
    gone = F.when(F.col("rel_path").contains("/subagents/"), F.concat(F.lit("projects/0-gone/"), "rel_path"))
    # each line and its copy in one pass: the lines are not made a second time
    both = first.withColumn("rel_path", F.explode(F.when(gone.isNotNull(), F.array("rel_path", gone)).otherwise(F.array("rel_path"))))
    write_jsonl(both, root, order=["ts", "line_seq", "kind"])
    UsageStore(spark, root, base + "/store").refresh()
    write_jsonl(lines, root, order=["ts", "line_seq", "kind"])
    delete_tree(spark, root + "/projects/0-gone")
    store = UsageStore(spark, root, base + "/store")
    store.refresh()
    return _period(R.daily_report(store.entries()), "date_key")


def q_growing_daily(spark, sf):
    """The logs grow in place between two refreshes; only new bytes are read."""
    from meterline.session import checkpoint_dir
    from meterline.sinks.jsonl import write_jsonl
    from meterline.sources.events_logs import usage_log_lines
    from meterline.streaming.stateful import LiveLog
    root = checkpoint_dir(spark).rstrip("/") + f"/meterline-refresh/{uuid.uuid4().hex[:8]}"
    lines = usage_log_lines(spark, sf)
    live = LiveLog(spark, root, views=("days",), growing=True)
    for upto in (lines.where(F.col("ts") < F.lit(REFRESH_SPLIT).cast("timestamp")), lines):
        write_jsonl(upto, root, order=["ts", "line_seq", "kind"])
        live.advance()
    return _period(live.daily(), "date_key")


def q_manifest_diff(spark, sf):
    root, state, old_manifest, diff_fn, manifest_fn = _two_phase_logs(spark, sf)
    d = diff_fn(old_manifest, manifest_fn(spark, root))
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


QUERIES.update({
    "growing_daily": q_growing_daily,
    "incremental_refresh": q_incremental_refresh,
    "refresh_by_keys": q_refresh_by_keys,
    "manifest_diff": q_manifest_diff,
})


# ---- documented extras (X1-X13) --------------------------------------------------



def q_model_breakdown(spark, sf):
    return X.model_breakdown(_facts(spark, sf))


def q_project_daily(spark, sf):
    return X.project_daily(_facts(spark, sf), project="PROJECTS/P3")


def q_iso_weekly_report(spark, sf):
    return _period(X.iso_weekly_report(_facts(spark, sf)), "week_key")


def q_month_stats(spark, sf):
    return X.month_stats(_facts(spark, sf))


def q_usage_stats(spark, sf):
    return X.usage_stats(_facts(spark, sf), "total_tokens")


def q_usage_trend(spark, sf):
    return X.usage_trend(X.daily_cost_series(_facts(spark, sf)))


def q_half_trend(spark, sf):
    return X.half_trend(X.daily_cost_series(_facts(spark, sf)))


def q_block_alerts(spark, sf):
    _, p = _projected(spark, sf)
    a = X.block_alerts(p)
    return a.select("session_id", "block_id", "rule", "level")


def q_cost_per_token(spark, sf):
    return X.cost_per_token(_facts(spark, sf))


def q_live_sessions(spark, sf):
    return X.live_sessions(_facts(spark, sf), AS_OF)


def q_gap_sessions(spark, sf):
    return X.gap_sessions(_facts(spark, sf)).drop("session_no")


def q_data_quality(spark, sf):
    # the view has no negative values: the check must return an empty frame
    return X.data_quality(usage_view(spark, sf)).select("entry_id", F.array_join("quality_issues", ";")
                                                        .alias("quality_issues"))


def q_sorted_report(spark, sf):
    d = R.daily_report(_facts(spark, sf))
    return X.sort_report(d, [("sessions", "desc"), ("date_key", "asc")]).select("date_key", "sessions", "cost")


QUERIES.update({
    "model_breakdown": q_model_breakdown,
    "project_daily": q_project_daily,
    "iso_weekly_report": q_iso_weekly_report,
    "month_stats": q_month_stats,
    "usage_stats": q_usage_stats,
    "usage_trend": q_usage_trend,
    "half_trend": q_half_trend,
    "block_alerts": q_block_alerts,
    "cost_per_token": q_cost_per_token,
    "live_sessions": q_live_sessions,
    "gap_sessions": q_gap_sessions,
    "data_quality": q_data_quality,
    "sorted_report": q_sorted_report,
})


# ---- detail, merge, labels, sinks ------------------------------------------------------

def q_session_file_detail(spark, sf):
    from meterline.operators.detail import session_file_detail
    return session_file_detail(priced_usage(spark, sf), order=VIEW_ORDER)


def q_merge_projects(spark, sf):
    from meterline.operators.dedup import merge_projects
    v = usage_view(spark, sf)
    p = F.substring_index("project_path", "/p", -1).cast("int")
    merged = merge_projects([v.where(p < 6), v.where(p >= 4)], order=VIEW_ORDER)
    return merged.select("entry_id", "session_id", "project_path")


def q_block_time_labels(spark, sf):
    from meterline.operators.detail import block_time_fields
    b = B.session_blocks(_facts(spark, sf), 5, "session_id", AS_OF)
    return block_time_fields(b, AS_OF).select("session_id", "block_id", "gap_hours", "span_hours", "span_minutes",
                                              "elapsed_hours", "elapsed_minutes_part", "remaining_hours",
                                              "remaining_minutes_part")


def q_entries_csv(spark, sf):
    from meterline.sinks.reports import entries_csv_rows
    return entries_csv_rows(_facts(spark, sf))


def q_block_types_csv(spark, sf):
    from meterline.sinks.reports import block_types_csv_rows
    return block_types_csv_rows(R.block_type_report(_facts(spark, sf)))


def q_blocks_csv(spark, sf):
    from meterline.sinks.reports import blocks_csv_rows
    return blocks_csv_rows(B.session_blocks(_facts(spark, sf), 5, None, AS_OF))


def q_sessions_csv(spark, sf):
    from meterline.sinks.reports import sessions_csv_rows
    return sessions_csv_rows(R.session_report(priced_usage(spark, sf), with_lists=True, order=VIEW_ORDER))


def q_usage_table(spark, sf):
    """Write the priced facts partitioned by day, read one day back: the
    read touches one partition only."""
    import uuid as _uuid
    from meterline.functions.timefns import date_key
    from meterline.session import checkpoint_dir
    from meterline.sinks.reports import write_usage_table
    path = checkpoint_dir(spark).rstrip("/") + f"/meterline-table/{_uuid.uuid4().hex[:8]}"
    write_usage_table(_facts(spark, sf).withColumn("date_key", date_key("ts")), path)
    day = spark.read.parquet(path).where(F.col("date_key") == "2024-01-15")
    return day.select("entry_id", F.col("date_key").cast("string").alias("date_key"), "total_tokens",
                      money_out("cost").alias("cost"))


QUERIES.update({
    "session_file_detail": q_session_file_detail,
    "merge_projects": q_merge_projects,
    "block_time_labels": q_block_time_labels,
    "entries_csv": q_entries_csv,
    "block_types_csv": q_block_types_csv,
    "blocks_csv": q_blocks_csv,
    "sessions_csv": q_sessions_csv,
    "usage_table": q_usage_table,
})


# ---- live metrics, remaining filters -------------------------------------------------

def q_stream_active_blocks(spark, sf):
    from meterline.streaming.live import live_block_metrics
    m = live_block_metrics(B.with_active_flag(_live(spark, sf, "blocks").blocks(), 5, AS_OF), 5, AS_OF, 50_000)
    return m.where("is_active").select(
        "session_id", "block_id", "entry_count", "total_tokens", "remaining_minutes", "projected_total_tokens",
        "limit_status", "burn_status", "usage_level", "projection_status")


def q_blocks_date_filtered(spark, sf):
    from meterline.operators.filters import filter_until_day
    f = filter_until_day(_facts(spark, sf), "2024-01-10", "2024-01-20", AS_OF)
    return _block_view(B.identify_blocks(f, 5, "session_id", AS_OF), "session_id")


def q_sessions_activity_filtered(spark, sf):
    from meterline.operators.filters import filter_sessions_activity
    s = R.session_report(priced_usage(spark, sf), order=VIEW_ORDER)
    return _sessions(filter_sessions_activity(s, "2024-01-30 20:00", "2024-01-30 23:59", tz="UTC"))


def q_weekly_default(spark, sf):
    s = R.weekly_report(priced_usage(spark, sf, names=False), as_of="2024-01-17 12:00:00")
    return s.withColumns({"models": map_joined("models"), "projects": map_joined("projects")})


def q_monthly_from_partials(spark, sf):
    """Day partials stored once; the months are added up from them, not from facts."""
    from meterline.operators.partials import day_partials, monthly_from_partials
    from meterline.session import materialize_checkpoint
    stored = materialize_checkpoint(day_partials(priced_usage(spark, sf, names=False), "Asia/Tokyo"))
    return _period(monthly_from_partials(stored, with_total=True), "month_key", total=True)


#: Four standard errors of a session sketch.
SKETCH_MARGIN = 0.052


def _sessions_close(estimated, exact, key):
    """The estimated report with ``sessions_close``: whether its sessions are
    within the margin of the exact count."""
    want = exact.select(F.col(key).alias("_k"), "is_total", F.col("sessions").alias("_want"))
    e = estimated.alias("e").join(want.alias("w"), F.col(f"e.{key}").eqNullSafe(F.col("w._k"))
                                  & (F.col("e.is_total") == F.col("w.is_total")))
    close = F.abs(F.col("sessions") - F.col("_want")) <= F.lit(SKETCH_MARGIN) * F.col("_want")
    return e.select("e.*", close.alias("sessions_close")).drop("sessions")


def q_daily_approx(spark, sf):
    x = priced_usage(spark, sf, names=False)
    est, exact = (R.daily_report(x, with_total=True, approx=a) for a in (True, False))
    return _sessions_close(_period(est, "date_key", total=True), exact, "date_key")


def q_monthly_from_sketches(spark, sf):
    """Day sketches stored once; the months are united from them, not from facts."""
    from meterline.operators.partials import day_sketches, monthly_from_sketches
    from meterline.session import materialize_checkpoint
    x = priced_usage(spark, sf, names=False)
    stored = materialize_checkpoint(day_sketches(x, "Asia/Tokyo"))
    est = _period(monthly_from_sketches(stored, with_total=True), "month_key", total=True)
    return _sessions_close(est, R.monthly_report(x, tz="Asia/Tokyo", with_total=True), "month_key")


QUERIES.update({
    "daily_approx": q_daily_approx,
    "monthly_from_sketches": q_monthly_from_sketches,
    "monthly_from_partials": q_monthly_from_partials,
    "stream_active_blocks": q_stream_active_blocks,
    "blocks_date_filtered": q_blocks_date_filtered,
    "sessions_activity_filtered": q_sessions_activity_filtered,
    "weekly_default": q_weekly_default,
})
