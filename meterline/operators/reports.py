"""Group-by reports (O4.*, O6.1-O6.2).

Each report is one aggregate (partial on the map side, so a hot key
never lands whole in one task) followed by an ``orderBy`` of the small
result.  Money is summed as exact decimals and rounded at the edge.
The grand-total row is a ``rollup``: distinct counts are recounted over all
groups, not summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.labels import is_real_model, model_label
from meterline.functions.timefns import date_key, first_monday_week, month_key, week_start_first_monday
from meterline.operators.common import money_out, nonempty, order_struct, sum0
from meterline.operators.filters import filter_days, filter_months, filter_range, valid_time
from meterline.schema import LOAD_ORDER

COST_MEASURES = [("api_cost", "api_cost"), ("cache_create_cost", "cache_create_cost"),
                 ("cache_read_cost", "cache_read_cost"), ("cost", "cost")]


def _token_sums():
    return [sum0("input_tokens").alias("input_tokens"),
            sum0("output_tokens").alias("output_tokens"),
            sum0("cache_create_tokens").alias("cache_create_tokens"),
            sum0("cache_read_tokens").alias("cache_read_tokens")]


def _cost_sums():
    return [F.sum(c).alias(a) for c, a in COST_MEASURES]


def _money_cols():
    return {a: money_out(F.coalesce(F.col(a), F.lit(0))) for _, a in COST_MEASURES}


def period_sums(df: DataFrame, key: str, key_expr, total_tokens_from_parts: bool,
                with_total: bool, label_models: bool = True, sessions=None) -> DataFrame:
    """Sums, distinct sessions and model labels per ``key``; the rows are entries
    or partial aggregates of them (``operators.partials``).  ``sessions`` is the
    aggregate that counts sessions, an exact distinct count if not given."""
    x = df.withColumn(key, key_expr)
    model_val = model_label("model") if label_models else F.col("model")
    if sessions is None:
        sessions = F.count_distinct(F.when(nonempty("session_id"), F.col("session_id")))
    aggs = [sessions.alias("sessions"),
            F.sort_array(F.collect_set(F.when(is_real_model("model"), model_val))).alias("models"),
            *_token_sums(),
            sum0("total_tokens").alias("_stored_total"),
            *_cost_sums()]
    if with_total:
        g = x.rollup(key).agg(*aggs, F.grouping(key).alias("_g"))
        g = g.withColumns({"is_total": F.col("_g") == 1,
                           "models": F.when(F.col("_g") == 1, F.array().cast("array<string>"))
                           .otherwise(F.col("models"))}).drop("_g")
    else:
        g = x.groupBy(key).agg(*aggs)
    total = (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_create_tokens")
             + F.col("cache_read_tokens")) if total_tokens_from_parts else F.col("_stored_total")
    g = g.withColumn("total_tokens", total.cast("bigint")).drop("_stored_total").withColumns(_money_cols())
    order = [F.col("is_total").asc(), F.col(key).asc()] if with_total else [F.col(key).asc()]
    return g.orderBy(*order)


#: log2 of the buckets of a session sketch: a relative standard error of about
#: 0.83 / sqrt(2^12), 1.3 %, in at most some 2 KB (4 bits a bucket).
SKETCH_LG_K = 12


def session_sketch(lg_k: int = SKETCH_LG_K):
    """HyperLogLog sketch of the non-empty session ids of a group."""
    return F.hll_sketch_agg(F.when(nonempty("session_id"), F.col("session_id")), F.lit(lg_k))


def _session_count(approx: bool):
    return F.hll_sketch_estimate(session_sketch()) if approx else None


def daily_report(df: DataFrame, tz: str = "UTC", since: str | None = None, until: str | None = None,
                 with_total: bool = False, approx: bool = False) -> DataFrame:
    """Per day in zone ``tz``: distinct sessions, model labels, token and cost
    sums; total tokens recomputed from the four parts (O4.1, O4.3).

    ``approx=True`` estimates the sessions from a sketch (``SKETCH_LG_K``): one
    row a day and task is shuffled instead of one per day and session."""
    x = filter_days(valid_time(df).withColumn("date_key", date_key("ts", tz)), since, until, tz=tz)
    return period_sums(x, "date_key", F.col("date_key"), True, with_total, sessions=_session_count(approx))


def monthly_report(df: DataFrame, tz: str = "UTC", since: str | None = None, until: str | None = None,
                   with_total: bool = False, approx: bool = False) -> DataFrame:
    """Per month; total tokens are the stored per-entry totals (O4.2, O4.3).
    ``approx`` as in ``daily_report``."""
    x = valid_time(df).withColumn("month_key", month_key(date_key("ts", tz)))
    x = filter_months(x, since, until, tz=tz)
    return period_sums(x, "month_key", F.col("month_key"), False, with_total, sessions=_session_count(approx))


def usage_summary(df: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Requests, cost, tokens, average cost and request counts per model and
    per project, for the whole frame or per ``group_cols`` (O4.4).

    One pass: grouping sets ((g), (g, model), (g, project)) then one fold, so
    no join and no cross join.
    """
    g = list(group_cols or [])
    x = df.withColumns({"_model": F.coalesce("model", F.lit("")),
                        "_project": F.coalesce("project_path", F.lit("")),
                        "_synthetic": F.col("model") == "<synthetic>"})
    sets = x.groupingSets([g, g + ["_model"], g + ["_project"]], *g, "_model", "_project").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~F.coalesce("_synthetic", F.lit(False)), F.lit(1))).alias("n_model"),
        F.sum("cost").alias("cost"), sum0("total_tokens").alias("tokens"),
        sum0("input_tokens").alias("inp"), sum0("output_tokens").alias("outp"),
        F.grouping("_model").alias("gm"), F.grouping("_project").alias("gp"))
    top = (F.col("gm") == 1) & (F.col("gp") == 1)
    by_model = (F.col("gm") == 0) & (F.col("n_model") > 0)
    by_project = F.col("gp") == 0
    out = sets.groupBy(*g).agg(
        F.sum(F.when(top, F.col("n"))).alias("total_requests"),
        F.sum(F.when(top, F.col("cost"))).alias("_cost"),
        F.sum(F.when(top, F.col("tokens"))).alias("total_tokens"),
        F.sum(F.when(top, F.col("inp"))).alias("input_tokens"),
        F.sum(F.when(top, F.col("outp"))).alias("output_tokens"),
        F.map_from_entries(F.sort_array(F.collect_list(
            F.when(by_model, F.struct(F.col("_model"), F.col("n_model")))))).alias("models"),
        F.map_from_entries(F.sort_array(F.collect_list(
            F.when(by_project, F.struct(F.col("_project"), F.col("n")))))).alias("projects"))
    total_cost = money_out(F.coalesce("_cost", F.lit(0)))
    return out.select(
        *g,
        F.coalesce("total_requests", F.lit(0)).cast("bigint").alias("total_requests"),
        total_cost.alias("total_cost"),
        F.coalesce("total_tokens", F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce("input_tokens", F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).cast("bigint").alias("output_tokens"),
        F.when(F.coalesce("total_requests", F.lit(0)) > 0, total_cost / F.col("total_requests"))
        .otherwise(F.lit(0.0)).alias("average_cost"),
        "models", "projects")


def period_report(df: DataFrame, kind: str, at: str, tz: str = "UTC") -> DataFrame:
    """One day ('YYYY-MM-DD') or month ('YYYY-MM') of zone ``tz``: range filter,
    then the summary with the period's bounds as instants (O4.9)."""
    from datetime import datetime
    if kind == "daily":
        start = datetime.strptime(at, "%Y-%m-%d")
        end_expr = F.lit(start.strftime("%Y-%m-%d")).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    elif kind == "monthly":
        start = datetime.strptime(at + "-01", "%Y-%m-%d")
        end_expr = F.add_months(F.lit(start.strftime("%Y-%m-%d")).cast("date"), 1).cast("timestamp")
    else:
        raise ValueError("kind must be 'daily' or 'monthly'")
    s = F.to_utc_timestamp(F.lit(start.strftime("%Y-%m-%d")).cast("timestamp"), tz)
    end_expr = F.to_utc_timestamp(end_expr, tz)
    return (usage_summary(filter_range(df, s, end_expr))
            .select(F.lit(kind).alias("period"), s.alias("start_time"), end_expr.alias("end_time"), "*"))


def weekly_report(df: DataFrame, year: int | None = None, week: int | None = None, as_of=None,
                  tz: str = "UTC") -> DataFrame:
    """Week ``week`` of ``year``, week 1 starting on the first Monday of zone
    ``tz``, ``[start, +7d)`` (O4.8).  Without year/week, the ISO year and week of
    ``as_of`` are used, as the reference does by default (O9.7); the two
    numberings differ in some years (SURVEY Q11)."""
    if year is None or week is None:
        from datetime import datetime
        at = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(str(as_of))
        iso = at.isocalendar()
        year, week = (year or iso[0]), (week or iso[1])
    s = week_start_first_monday(year, week)
    s, e = F.to_utc_timestamp(s, tz), F.to_utc_timestamp(s + F.expr("INTERVAL 7 DAYS"), tz)
    return (usage_summary(filter_range(df, s, e))
            .select(F.lit("weekly").alias("period"), s.alias("start_time"), e.alias("end_time"), "*"))


def weekly_report_all(df: DataFrame) -> DataFrame:
    """Every first-Monday week that has entries, with its summary (O4.8)."""
    w = first_monday_week("ts")
    x = valid_time(df).withColumns({"week_year": w["year"], "week": w["week"], "start_time": w["week_start"]})
    out = usage_summary(x, ["week_year", "week", "start_time"])
    return out.withColumn("end_time", F.col("start_time") + F.expr("INTERVAL 7 DAYS")) \
        .orderBy("week_year", "week")


def session_report(df: DataFrame, with_lists: bool = False, order: list[str] = LOAD_ORDER) -> DataFrame:
    """The "session" report, grouped by project path ('unknown' if empty) (O4.5).

    ``n_session_ids`` / ``n_source_files`` count the members; the sorted member
    lists are in ``session_members``.  ``with_lists=True`` embeds them as
    arrays, which is only sensible when a project's member count is small.
    """
    key = F.coalesce(F.when(F.col("project_path") != "", F.col("project_path")), F.lit("unknown"))
    named = F.when(nonempty("session_name"), F.struct(F.col("ts").alias("ts"), order_struct(order).alias("o"),
                                                      F.col("session_name").alias("name")))
    aggs = [F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
            F.count(F.lit(1)).alias("request_count"),
            *_token_sums(), sum0("total_tokens").alias("total_tokens"),
            F.sum("cost").alias("total_cost"), F.sum("api_cost").alias("total_api_cost"),
            F.sum("cache_create_cost").alias("cache_create_cost"),
            F.sum("cache_read_cost").alias("cache_read_cost"),
            F.min(named).alias("_first_named"),
            F.sort_array(F.collect_set(F.when(is_real_model("model"), F.col("model")))).alias("models_used"),
            F.count_distinct(F.when(nonempty("session_id"), F.col("session_id"))).alias("n_session_ids"),
            F.count_distinct(F.when(nonempty("source_file"), F.col("source_file"))).alias("n_source_files")]
    if with_lists:
        aggs += [F.sort_array(F.collect_set(F.when(nonempty("session_id"), F.col("session_id"))))
                 .alias("session_ids"),
                 F.sort_array(F.collect_set(F.when(nonempty("source_file"), F.col("source_file"))))
                 .alias("source_files")]
    g = df.withColumn("_project", key).groupBy("_project").agg(*aggs)
    out = g.withColumns({
        "project_path": F.col("_project"),
        "session_name": F.coalesce(F.col("_first_named.name"), F.lit("")),
        "duration_seconds": (F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1e6),
        "last_activity": F.col("end_time"),
        "total_cost": money_out(F.coalesce("total_cost", F.lit(0))),
        "total_api_cost": money_out(F.coalesce("total_api_cost", F.lit(0))),
        "cache_create_cost": money_out(F.coalesce("cache_create_cost", F.lit(0))),
        "cache_read_cost": money_out(F.coalesce("cache_read_cost", F.lit(0))),
    }).drop("_project", "_first_named")
    return out.orderBy("start_time", "project_path")


def session_members(df: DataFrame) -> DataFrame:
    """Sorted distinct session ids and source files of each project path,
    long form ``(project_path, kind, member)``: a distributed table instead of
    one unbounded array per project."""
    key = F.coalesce(F.when(F.col("project_path") != "", F.col("project_path")), F.lit("unknown"))
    sids = df.where(nonempty("session_id")).select(key.alias("project_path"), F.lit("session_id").alias("kind"),
                                                   F.col("session_id").alias("member"))
    files = df.where(nonempty("source_file")).select(key.alias("project_path"), F.lit("source_file").alias("kind"),
                                                     F.col("source_file").alias("member"))
    return sids.unionByName(files).distinct()


def source_file_report(df: DataFrame) -> DataFrame:
    """Per source file: sums, entry count, last activity, sorted models (O4.6)."""
    g = df.where(nonempty("source_file")).groupBy("source_file").agg(
        *_token_sums(), *_cost_sums(),
        F.sort_array(F.collect_set(F.when(is_real_model("model"), F.col("model")))).alias("models_used"),
        F.max("ts").alias("last_activity"), F.count(F.lit(1)).alias("entry_count"))
    g = g.withColumn("total_tokens", (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_create_tokens")
                                      + F.col("cache_read_tokens")).cast("bigint"))
    return g.withColumns(_money_cols()).withColumnRenamed("source_file", "file_path").orderBy("file_path")


def block_type_report(df: DataFrame) -> DataFrame:
    """Per block type: count, tokens, cost, first and last seen; most used
    first (O4.7)."""
    g = df.where(nonempty("block_type")).groupBy("block_type").agg(
        F.count(F.lit(1)).alias("count"), sum0("total_tokens").alias("total_tokens"),
        F.sum("cost").alias("_cost"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return (g.withColumn("total_cost", money_out(F.coalesce("_cost", F.lit(0)))).drop("_cost")
            .orderBy(F.desc("count"), F.asc("block_type")))


def usage_totals(df: DataFrame) -> DataFrame:
    """Requests, cost and tokens over everything (O4.10)."""
    return df.agg(F.count(F.lit(1)).alias("total_requests"),
                  money_out(F.coalesce(F.sum("cost"), F.lit(0))).alias("total_cost"),
                  sum0("total_tokens").cast("bigint").alias("total_tokens"))


def recent_entries(df: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` entries (O6.2): a TakeOrdered, never a global sort."""
    return df.orderBy(F.desc("ts"), F.desc("source_file"), F.desc("line_seq")).limit(n)
