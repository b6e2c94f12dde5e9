"""Operators described in the reference's design documents (X1-X13).

Statistics are exact: sums are taken over integers or decimals and only the
final ratios are doubles, so results do not depend on partitioning.  Order
statistics use a range-partitioned selection (no single task holds all
values) and sequential rules run on small compressed tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.timefns import date_key, iso_week_key
from meterline.operators.common import key_list, money_out, nonempty, sum0
from meterline.operators.reports import period_sums
from meterline.operators.filters import valid_time
from meterline.schema import MONEY

# fixed values of the documented rules
TREND_STABLE_SLOPE = 0.01
HALF_TREND_MIN_POINTS = 10
HALF_TREND_THRESHOLD = 0.1
ALERT_COST_PER_HOUR = 50.0
ALERT_REMAINING_MINUTES = 30.0
ALERT_BLOCK_COST = 150.0
ACTIVE_SESSION_HOURS = 5


def model_breakdown(df: DataFrame, tz: str = "UTC", period: str = "day") -> DataFrame:
    """Per period and model: requests, token sums, cost (X1)."""
    key = date_key("ts", tz) if period == "day" else F.substring(date_key("ts", tz), 1, 7)
    return (valid_time(df).withColumn("period", key)
            .groupBy("period", F.coalesce("model", F.lit("")).alias("model"))
            .agg(F.count(F.lit(1)).alias("requests"), sum0("input_tokens").alias("input_tokens"),
                 sum0("output_tokens").alias("output_tokens"),
                 sum0("cache_create_tokens").alias("cache_create_tokens"),
                 sum0("cache_read_tokens").alias("cache_read_tokens"),
                 sum0("total_tokens").alias("total_tokens"),
                 money_out(F.coalesce(F.sum("cost"), F.lit(0))).alias("cost"))
            .orderBy("period", "model"))


def project_daily(df: DataFrame, tz: str = "UTC", project: str | None = None, exact: bool = False) -> DataFrame:
    """Per project and day; optional project filter, exact or contained,
    case-insensitive (X2)."""
    x = valid_time(df)
    if project:
        p = F.lower(F.coalesce("project_path", F.lit("")))
        x = x.where(p == project.lower()) if exact else x.where(p.contains(project.lower()))
    x = x.withColumn("date_key", date_key("ts", tz))
    return (x.groupBy(F.coalesce("project_path", F.lit("")).alias("project_path"), "date_key")
            .agg(F.count(F.lit(1)).alias("requests"), sum0("total_tokens").alias("total_tokens"),
                 money_out(F.coalesce(F.sum("cost"), F.lit(0))).alias("cost"))
            .orderBy("project_path", "date_key"))


def iso_weekly_report(df: DataFrame) -> DataFrame:
    """The daily report's measures per ISO week 'YYYY-Www' (X3)."""
    x = valid_time(df)
    return period_sums(x, "week_key", iso_week_key("ts"), True, False)


def daily_cost_series(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """(date_key, cost as exact decimal rounded to 6, tokens) per day."""
    return (valid_time(df).withColumn("date_key", date_key("ts", tz)).groupBy("date_key")
            .agg(F.round(F.coalesce(F.sum("cost"), F.lit(0)).cast(MONEY), 6).alias("cost"),
                 sum0("total_tokens").alias("total_tokens")))


def month_stats(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Per month: active days, totals, average per active day, peak day and
    change against the previous month in percent (X4)."""
    daily = daily_cost_series(df, tz).withColumn("month", F.substring("date_key", 1, 7))
    m = daily.groupBy("month").agg(
        F.count(F.lit(1)).alias("days_active"), F.sum("cost").alias("total_cost"),
        F.sum("total_tokens").alias("total_tokens"),
        F.max_by("date_key", F.struct("cost", F.col("date_key"))).alias("peak_day"),
        F.max("cost").alias("peak_day_cost"))
    # one row per month: the window runs over a table bounded by the time span
    w = Window.partitionBy(F.lit(0)).orderBy("month")
    prev = F.lag("total_cost").over(w)
    return m.select(
        "month", "days_active", money_out("total_cost").alias("total_cost"), "total_tokens",
        (F.col("total_cost").cast("double") / F.col("days_active")).alias("average_daily_cost"),
        (F.col("total_tokens") / F.col("days_active")).cast("bigint").alias("average_daily_tokens"),
        "peak_day", money_out("peak_day_cost").alias("peak_day_cost"),
        F.when(prev > 0, (F.col("total_cost") - prev).cast("double") / prev.cast("double") * 100)
        .alias("change_percent")).orderBy("month")


def sort_report(df: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    """Multi-field sort, each field 'asc' or 'desc' (X5)."""
    return df.orderBy(*[F.col(c).desc() if d.lower() == "desc" else F.col(c).asc() for c, d in spec])


def order_statistics(df: DataFrame, value_col: str, ranks: dict[str, Column],
                     partitions: int | None = None) -> DataFrame:
    """Exact k-th smallest values (1-based ranks given as expressions of
    ``n``) without collecting the column anywhere.

    Distinct values with their counts are range-partitioned by value; a tiny
    per-partition table gives each partition its rank offset, and a window
    inside each range partition finds the rows whose rank span holds k.
    """
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vc = (df.where(F.col(value_col).isNotNull()).groupBy(value_col).agg(F.count(F.lit(1)).alias("_c"))
          .repartitionByRange(n_parts, value_col).withColumn("_pid", F.spark_partition_id()))
    from meterline.session import materialize_checkpoint
    vc = materialize_checkpoint(vc)
    per = vc.groupBy("_pid").agg(F.sum("_c").alias("_pc"))
    w_all = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_pid", F.coalesce(F.sum("_pc").over(w_all), F.lit(0)).alias("_off"),
                         F.sum("_pc").over(Window.partitionBy(F.lit(0))).alias("_n"))
    w_in = Window.partitionBy("_pid").orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    spans = (vc.join(F.broadcast(offsets), "_pid")
             .withColumn("_hi", F.col("_off") + F.sum("_c").over(w_in))
             .withColumn("_lo", F.col("_hi") - F.col("_c") + 1))
    outs = []
    for name, rank in ranks.items():
        k = rank(F.col("_n"))
        outs.append(spans.where((F.col("_lo") <= k) & (k <= F.col("_hi")))
                    .select(F.lit(name).alias("stat"), F.col(value_col).alias("value")))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def usage_stats(df: DataFrame, value_col: str = "total_tokens") -> DataFrame:
    """count, sum, mean, min, max, population std-dev, median = v[n/2] and
    p95 = v[int(0.95 n)] over the 0-based sorted values (X6)."""
    x = df.where(F.col(value_col).isNotNull())
    v = F.col(value_col).cast("decimal(38,0)")
    agg = x.agg(F.count(F.lit(1)).alias("count"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"),
                F.min(value_col).alias("min"), F.max(value_col).alias("max"))
    stats = order_statistics(x, value_col, {
        "median": lambda n: F.floor(n / 2) + 1,
        "p95": lambda n: F.floor(n.cast("double") * 0.95) + 1,
    })
    med = stats.where(F.col("stat") == "median").select(F.col("value").alias("median"))
    p95 = stats.where(F.col("stat") == "p95").select(F.col("value").alias("p95"))
    n = F.col("count").cast("double")
    var_num = (F.col("count").cast("decimal(38,0)") * F.col("s2") - F.col("s") * F.col("s"))
    out = agg.select(
        "count", F.col("s").cast("bigint").alias("sum"),
        (F.col("s").cast("double") / n).alias("average"), "min", "max",
        F.sqrt(var_num.cast("double") / (n * n)).alias("std_dev"))
    # the two order statistics are one-row scalar subqueries
    return out.withColumns({"median": med.scalar(), "p95": p95.scalar()})


def _regression(series: DataFrame, order_col: str, y_col: str) -> DataFrame:
    """Exact sums for y over x = 0..n-1 in ``order_col`` order."""
    w = Window.partitionBy(F.lit(0)).orderBy(order_col)
    s = series.withColumn("_x", (F.row_number().over(w) - 1).cast("decimal(38,0)"))
    y = F.col(y_col).cast("decimal(38,6)")
    return s.agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"), F.sum("_x").alias("sx"),
                 F.sum(y).alias("sy"), F.sum(F.col("_x") * y).alias("sxy"),
                 F.sum(F.col("_x") * F.col("_x")).alias("sx2"), F.sum(y * y).alias("sy2"))


def usage_trend(series: DataFrame, order_col: str = "date_key", y_col: str = "cost") -> DataFrame:
    """Least-squares trend of y over its position: slope, correlation (the
    square root of the coefficient of determination), direction and the next
    value (X7).  Fewer than two points: stable."""
    r = _regression(series, order_col, y_col)
    num = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double")
    dx = (F.col("n") * F.col("sx2") - F.col("sx") * F.col("sx")).cast("double")
    dy = (F.col("n") * F.col("sy2") - F.col("sy") * F.col("sy")).cast("double")
    slope = num / dx
    n = F.col("n").cast("double")
    intercept = (F.col("sy").cast("double") - slope * F.col("sx").cast("double")) / n
    ok = F.col("n") >= 2
    return r.select(
        F.col("n").cast("bigint").alias("points"),
        F.when(ok, slope).alias("slope"),
        F.when(ok, F.abs(num) / F.sqrt(dx * dy)).alias("correlation"),
        F.when(~ok | (F.abs(slope) < TREND_STABLE_SLOPE), F.lit("stable"))
        .when(slope > 0, F.lit("increasing")).otherwise(F.lit("decreasing")).alias("direction"),
        F.when(ok, slope * n + intercept).alias("prediction"))


def half_trend(series: DataFrame, order_col: str = "date_key", y_col: str = "cost") -> DataFrame:
    """First half against second half of the points: +-10 %, at least 10
    points (X8)."""
    w = Window.partitionBy(F.lit(0)).orderBy(order_col)
    s = series.withColumns({"_i": F.row_number().over(w) - 1,
                            "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    mid = F.floor(F.col("_n") / 2)
    y = F.col(y_col).cast("decimal(38,6)")
    g = s.agg(F.max("_n").alias("n"), F.sum(F.when(F.col("_i") < mid, y)).alias("a"),
              F.sum(F.when(F.col("_i") >= mid, y)).alias("b"),
              F.max(mid).alias("mid"))
    first = F.col("a").cast("double") / F.col("mid")
    second = F.col("b").cast("double") / (F.col("n") - F.col("mid"))
    diff = F.when(first != 0, (second - first) / first)
    return g.select(F.col("n").cast("bigint").alias("points"), first.alias("first_half_avg"),
                    second.alias("second_half_avg"),
                    F.when(F.col("n") < HALF_TREND_MIN_POINTS, F.lit("stable"))
                    .when(diff > HALF_TREND_THRESHOLD, F.lit("increasing"))
                    .when(diff < -HALF_TREND_THRESHOLD, F.lit("decreasing"))
                    .otherwise(F.lit("stable")).alias("trend"))


def block_alerts(blocks: DataFrame) -> DataFrame:
    """Alert rows for active blocks: cost/hour > 50 (warning); under 30
    minutes left and cost > 150 (critical) (X9).  Expects burn rate and
    projection columns."""
    cost = F.col("cost_usd").cast("double")
    high = F.col("cost_per_hour") > ALERT_COST_PER_HOUR
    near = (F.col("remaining_minutes") < ALERT_REMAINING_MINUTES) & (cost > ALERT_BLOCK_COST)
    alerts = F.filter(F.array(
        F.when(high, F.struct(F.lit("high_burn_rate").alias("rule"), F.lit("warning").alias("level"))),
        F.when(near, F.struct(F.lit("block_limit_approaching").alias("rule"), F.lit("critical").alias("level")))),
        lambda a: a.isNotNull())
    return blocks.where(F.col("is_active")).select("*", F.inline(alerts))


def cost_per_token(df: DataFrame, group: str = "project_path") -> DataFrame:
    """Per group: cost per token and the most used model (X10)."""
    by_model = df.groupBy(group, F.coalesce("model", F.lit("")).alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), sum0("total_tokens").alias("tokens"))
    return by_model.groupBy(group).agg(
        F.sum("n").alias("requests"), money_out(F.sum("cost")).alias("total_cost"),
        F.sum("tokens").alias("total_tokens"),
        F.when(F.sum("tokens") > 0, F.sum("cost").cast("double") / F.sum("tokens")).alias("cost_per_token"),
        F.max_by("model", F.struct("n", F.col("model"))).alias("most_used_model"))


def live_sessions(df: DataFrame, as_of, key: str = "session_id", hours: int = ACTIVE_SESSION_HOURS) -> DataFrame:
    """Per session: last seen, requests, cost, active when seen in the last
    5 hours (X11)."""
    now = F.lit(as_of).cast("timestamp")
    g = df.where(nonempty(key)).groupBy(key).agg(
        F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("requests"),
        money_out(F.sum("cost")).alias("cost"))
    return g.withColumn("is_active", (F.unix_micros(now) - F.unix_micros("last_seen"))
                        < F.lit(hours * 3600 * 1_000_000))


def gap_sessions(df: DataFrame, key="session_id", gap_hours: int = 5, min_duration_s: float = 0.0) -> DataFrame:
    """Sessions split after more than ``gap_hours`` idle (X12), per key.

    Two entries in the same gap-length bucket are closer than the gap, so a
    split can only fall between buckets: entries are first compressed to
    one row per key and bucket (partial aggregation, skew-safe) and the
    sequential rule runs over buckets, a table bounded by the time span.
    """
    keys = key_list(key)
    gap_us = gap_hours * 3600 * 1_000_000
    x = df.where(F.col("ts").isNotNull()).withColumn("_b", F.floor(F.unix_micros("ts") / gap_us))
    b = x.groupBy(*keys, "_b").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"),
        sum0("input_tokens").alias("input_tokens"), sum0("output_tokens").alias("output_tokens"),
        F.sum("cost").alias("cost"),
        F.collect_set(F.coalesce("model", F.lit(""))).alias("models"))
    part = keys if keys else [F.lit(0)]
    w = Window.partitionBy(*part).orderBy("_b")
    prev_last = F.lag("last_ts").over(w)
    b = b.withColumn("_new", F.when(prev_last.isNull(), 1).when(
        F.unix_micros("first_ts") - F.unix_micros(prev_last) > gap_us, 1).otherwise(0))
    b = b.withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = b.groupBy(*keys, "session_no").agg(
        F.min("first_ts").alias("start_time"), F.max("last_ts").alias("end_time"),
        F.sum("n").alias("request_count"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), money_out(F.sum("cost")).alias("total_cost"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))), ";").alias("models_used"))
    dur = (F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1e6)
    s = s.withColumns({"duration_seconds": dur,
                       "average_interval_seconds": F.when(F.col("request_count") > 1,
                                                          dur / (F.col("request_count") - 1))})
    return s.where(F.col("duration_seconds") >= min_duration_s)


def data_quality(df: DataFrame) -> DataFrame:
    """Rows with negative token counts or cost, with the reason (X13)."""
    checks = [("negative_input_tokens", F.col("input_tokens") < 0),
              ("negative_output_tokens", F.col("output_tokens") < 0),
              ("negative_cache_tokens", (F.col("cache_create_tokens") < 0) | (F.col("cache_read_tokens") < 0)),
              ("negative_cost", F.col("logged_cost") < 0)]
    reasons = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]),
                       lambda r: r.isNotNull())
    return df.withColumn("quality_issues", reasons).where(F.size("quality_issues") > 0)
