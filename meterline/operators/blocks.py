"""Billing blocks (O5.*, O4.11, O6.4).

Rule: sort by time; a block starts at its first entry floored to the hour;
an entry stays in the block while ``t - start <= D`` and ``t - last <= D``.
Because the start is an hour mark, D is whole hours and ``start <= last <= t``,
the rule reduces to "a new block starts at the first entry with
``t > start + D``", and whether an entry splits depends only on the pair
``(hour(t), t > hour(t))``.

Plan, with no global sort and no range join:

1. ``hourly``: one hash aggregate of the facts by (key, hour, strict) with
   every block measure (all decomposable).  Partial aggregation on the map
   side, so a hot key is reduced before the shuffle; the output has at most
   two rows per key and hour.
2. Per key, the sorted (hour, strict) marks are folded with ``aggregate`` into
   the list of block starts (a key's list is bounded by its time span, about
   17,500 marks per year, not by its row count).
3. Start marks and hour rows are unioned and ``last(start, ignorenulls)`` over
   a window per key gives every hour row its block start.  The compressed
   table feeds both steps, so it is checkpointed once (small: two rows per
   key and hour at most) and the facts are aggregated a single time.
4. A second small aggregate by (key, block start) merges the hour rows.

Gaps, burn rate, projection and limit status are column expressions and
``lead`` windows over the block table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.timefns import minutes_between
from meterline.operators.common import key_list, money_out
from meterline.schema import MONEY

DEFAULT_HOURS = 5
WARNING_PERCENT = 80.0          # token-limit warning threshold
# fixed values: live indicator thresholds
BURN_HIGH = 1000                # non-cache tokens per minute
BURN_MODERATE = 500
PROJECTION_EXCEEDS = 100
PROJECTION_APPROACHING = 90
USAGE_RED = 95
USAGE_YELLOW = 80

_MARK = "struct<hs:bigint,strict:boolean>"


def _rfc3339(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hourly_usage(df: DataFrame, key=None) -> DataFrame:
    """Step 1: per (key, hour, strict) partial sums of every block measure."""
    keys = key_list(key)
    h = F.date_trunc("hour", F.col("ts"))
    reset = F.try_to_timestamp(F.col("usage_limit_reset_time")) if "usage_limit_reset_time" in df.columns \
        else F.lit(None).cast("timestamp")
    return (df.where(F.col("ts").isNotNull())
            .withColumns({"_hs": F.unix_seconds(h), "_strict": F.col("ts") > h, "_reset": reset})
            .groupBy(*keys, "_hs", "_strict")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
                 F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
                 F.sum(F.coalesce("cache_create_tokens", F.lit(0))).alias("cache_creation_input_tokens"),
                 F.sum(F.coalesce("cache_read_tokens", F.lit(0))).alias("cache_read_input_tokens"),
                 F.sum("cost").alias("cost_usd"), F.sum("api_cost").alias("api_cost_usd"),
                 F.sum("cache_create_cost").alias("cache_create_cost_usd"),
                 F.sum("cache_read_cost").alias("cache_read_cost_usd"),
                 F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                 F.collect_set(F.when(F.col("model") != "", F.col("model"))).alias("models"),
                 F.max_by("_reset", F.when(F.col("_reset").isNotNull(), F.col("ts"))).alias("reset_time")))


def _block_starts(hourly: DataFrame, keys: list[str], hours: int) -> DataFrame:
    """Step 2: the fold over compressed marks -> one row per block start."""
    d = hours * 3600
    marks = hourly.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_hs").alias("hs"), F.col("_strict").alias("strict"))))
        .alias("xs"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        new = ((F.size(acc) == 0) | (x["hs"] > last["hs"] + d)
               | ((x["hs"] == last["hs"] + d) & x["strict"]))
        return F.when(new, F.concat(acc, F.array(x))).otherwise(acc)

    starts = marks.select(*keys, F.aggregate("xs", F.array().cast(f"array<{_MARK}>"), step).alias("starts"))
    return starts.select(*keys, F.inline("starts")).withColumnsRenamed({"hs": "_hs", "strict": "_strict"})


def block_assignment(df: DataFrame, hours: int = DEFAULT_HOURS, key=None,
                     hourly: DataFrame | None = None) -> DataFrame:
    """(key, hour mark, strict) -> block start, plus the hour's measures."""
    from meterline.session import materialize_checkpoint
    keys = key_list(key)
    # the compressed table feeds two branches: materialize it once so the
    # facts are aggregated a single time
    hourly = hourly if hourly is not None else materialize_checkpoint(hourly_usage(df, key))
    starts = _block_starts(hourly, keys, hours).withColumn("_is_start", F.lit(True))
    rows = hourly.withColumn("_is_start", F.lit(False))
    both = rows.unionByName(starts, allowMissingColumns=True)
    part = keys if keys else [F.lit(0)]
    w = (Window.partitionBy(*part).orderBy("_hs", "_strict", F.desc("_is_start"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (both.withColumn("_block_hs", F.last(F.when(F.col("_is_start"), F.col("_hs")), ignorenulls=True).over(w))
            .where(~F.col("_is_start")).drop("_is_start"))


def assign_blocks(df: DataFrame, hours: int = DEFAULT_HOURS, key=None) -> DataFrame:
    """Every entry with its ``block_start`` (O5.1).

    The assignment table has at most two rows per key and hour; it is
    joined as the planner chooses by its size.
    """
    keys = key_list(key)
    assign = block_assignment(df, hours, key).select(*keys, "_hs", "_strict", "_block_hs")
    h = F.date_trunc("hour", F.col("ts"))
    facts = df.where(F.col("ts").isNotNull()).withColumns({"_hs": F.unix_seconds(h), "_strict": F.col("ts") > h})
    out = facts.join(assign, [*keys, "_hs", "_strict"], "inner")
    return out.withColumn("block_start", F.timestamp_seconds("_block_hs")).drop("_hs", "_strict", "_block_hs")


def identify_blocks(df: DataFrame, hours: int = DEFAULT_HOURS, key=None, as_of=None) -> DataFrame:
    """Block table without gap rows (O5.1-O5.3, O5.5)."""
    keys = key_list(key)
    a = block_assignment(df, hours, key)
    g = a.groupBy(*keys, "_block_hs").agg(
        F.sum("n").alias("entry_count"),
        *[F.sum(c).alias(c) for c in ["input_tokens", "output_tokens", "cache_creation_input_tokens",
                                      "cache_read_input_tokens"]],
        *[F.sum(c).alias(c) for c in ["cost_usd", "api_cost_usd", "cache_create_cost_usd", "cache_read_cost_usd"]],
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("actual_end_time"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"),
        F.max_by("reset_time", F.when(F.col("reset_time").isNotNull(), F.col("last_ts")))
        .alias("usage_limit_reset_time"))
    start = F.timestamp_seconds("_block_hs")
    end = F.timestamp_seconds(F.col("_block_hs") + hours * 3600)
    out = g.select(
        *keys,
        _rfc3339(start).alias("block_id"),
        start.alias("start_time"), end.alias("end_time"),
        "actual_end_time", "first_ts",
        F.lit(False).alias("is_gap"),
        "entry_count", "input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens",
        (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_input_tokens")
         + F.col("cache_read_input_tokens")).alias("total_tokens"),
        *[F.coalesce(c, F.lit(0)).cast(MONEY).alias(c)
          for c in ["cost_usd", "api_cost_usd", "cache_create_cost_usd", "cache_read_cost_usd"]],
        "models", "usage_limit_reset_time")
    return with_active_flag(out, hours, as_of)


def with_active_flag(blocks: DataFrame, hours: int, as_of) -> DataFrame:
    """``as_of - last < D`` and ``as_of < end`` (O5.3); False without ``as_of``."""
    if as_of is None:
        return blocks.withColumn("is_active", F.lit(False))
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    d_us = hours * 3600 * 1_000_000
    active = ((F.unix_micros(now) - F.unix_micros("actual_end_time") < d_us)
              & (now < F.col("end_time")) & ~F.col("is_gap"))
    return blocks.withColumn("is_active", F.coalesce(active, F.lit(False)))


def gap_blocks(blocks: DataFrame, hours: int = DEFAULT_HOURS, key=None) -> DataFrame:
    """Gap rows between consecutive blocks whose idle time exceeds D (O5.4)."""
    keys = key_list(key)
    part = keys if keys else [F.lit(0)]
    w = Window.partitionBy(*part).orderBy("start_time")
    nxt = blocks.withColumn("_next_first", F.lead("first_ts").over(w))
    d_us = hours * 3600 * 1_000_000
    gaps = nxt.where(F.unix_micros("_next_first") - F.unix_micros("actual_end_time") > d_us)
    gap_start = F.timestamp_micros(F.unix_micros("actual_end_time") + d_us)
    zero_money = F.lit(0).cast(MONEY)
    return gaps.select(
        *keys,
        F.concat(F.lit("gap-"), _rfc3339(gap_start)).alias("block_id"),
        gap_start.alias("start_time"), F.col("_next_first").alias("end_time"),
        F.lit(None).cast("timestamp").alias("actual_end_time"),
        F.lit(None).cast("timestamp").alias("first_ts"),
        F.lit(True).alias("is_gap"),
        F.lit(0).cast("bigint").alias("entry_count"),
        *[F.lit(0).cast("bigint").alias(c) for c in ["input_tokens", "output_tokens",
                                                     "cache_creation_input_tokens", "cache_read_input_tokens",
                                                     "total_tokens"]],
        *[zero_money.alias(c) for c in ["cost_usd", "api_cost_usd", "cache_create_cost_usd",
                                        "cache_read_cost_usd"]],
        F.array().cast("array<string>").alias("models"),
        F.lit(None).cast("timestamp").alias("usage_limit_reset_time"),
        F.lit(False).alias("is_active"))


def session_blocks(df: DataFrame, hours: int = DEFAULT_HOURS, key=None, as_of=None,
                   with_gaps: bool = True) -> DataFrame:
    """Blocks and gap rows ordered by time (O5.1-O5.5)."""
    blocks = identify_blocks(df, hours, key, as_of)
    if with_gaps:
        blocks = blocks.unionByName(gap_blocks(blocks, hours, key))
    return blocks


def with_burn_rate(blocks: DataFrame) -> DataFrame:
    """Tokens/min, non-cache tokens/min and cost/hour over first..last entry;
    NULL for gaps and zero spans (O5.6)."""
    mins = minutes_between("actual_end_time", "first_ts")
    ok = ~F.col("is_gap") & (mins > 0) & (F.col("entry_count") > 0)
    cost = F.col("cost_usd").cast("double")
    return blocks.withColumns({
        "tokens_per_minute": F.when(ok, F.col("total_tokens") / mins),
        "tokens_per_minute_for_indicator": F.when(ok, (F.col("input_tokens") + F.col("output_tokens")) / mins),
        "cost_per_hour": F.when(ok, cost / mins * 60),
    })


def with_projection(blocks: DataFrame, as_of) -> DataFrame:
    """For active blocks with a burn rate: remaining minutes (>= 0), projected
    total tokens (truncated toward zero) and projected cost (O5.7, O5.12)."""
    b = blocks if "tokens_per_minute" in blocks.columns else with_burn_rate(blocks)
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    rem = F.greatest(minutes_between("end_time", now), F.lit(0.0))
    ok = F.col("is_active") & ~F.col("is_gap") & F.col("tokens_per_minute").isNotNull()
    return b.withColumns({
        "elapsed_minutes": F.when(F.col("is_active"), minutes_between(now, "start_time")),
        "remaining_minutes": F.when(ok, rem),
        "projected_total_tokens": F.when(ok, F.col("total_tokens")
                                         + (F.col("tokens_per_minute") * rem).cast("bigint")),
        "projected_total_cost": F.when(ok, F.col("cost_usd").cast("double") + F.col("cost_per_hour") / 60 * rem),
    })


def max_block_tokens(blocks: DataFrame) -> DataFrame:
    """Largest total over closed (non-gap, inactive) blocks, 0 if none (O4.11)."""
    return blocks.agg(F.coalesce(F.max(F.when(~F.col("is_gap") & ~F.col("is_active"), F.col("total_tokens"))),
                                 F.lit(0)).cast("bigint").alias("max_tokens"))


def with_limit_status(blocks: DataFrame, limit: int | str | None = None,
                      all_blocks: DataFrame | None = None) -> DataFrame:
    """Token-limit status (O5.8, O5.9).

    ``limit`` is a number, or None / '' / 'max' for the largest closed block
    of ``all_blocks`` (the table before any filter), taken as a scalar
    subquery.
    """
    if limit in (None, "", "max"):
        src = all_blocks if all_blocks is not None else blocks
        # scalar subquery: computed once, inlined as a value, no join
        lim = max_block_tokens(src).scalar()
    else:
        lim = F.lit(int(limit))
    out = blocks.withColumn("token_limit", lim.cast("bigint"))
    has = F.col("token_limit") > 0
    pct = F.col("projected_total_tokens") / F.col("token_limit") * 100
    remaining = F.greatest(F.col("token_limit") - F.col("total_tokens"), F.lit(0))
    return out.withColumns({
        "percent_of_limit": F.when(has & ~F.col("is_gap"), F.col("total_tokens") / F.col("token_limit") * 100),
        "remaining_tokens": F.when(has & F.col("is_active"), remaining),
        "remaining_percent": F.when(has & F.col("is_active"), remaining / F.col("token_limit") * 100),
        "projected_percent": F.when(has & F.col("projected_total_tokens").isNotNull(), pct),
        "limit_status": F.when(has & F.col("projected_total_tokens").isNotNull(),
                               F.when(pct > 100, F.lit("exceeds"))
                               .when(pct > WARNING_PERCENT, F.lit("warning")).otherwise(F.lit("ok"))),
    })


def with_live_status(blocks: DataFrame, token_limit: int) -> DataFrame:
    """Live indicator labels (O5.10)."""
    usage_pct = F.when(F.lit(token_limit) > 0, F.col("total_tokens") / F.lit(token_limit) * 100) \
        .otherwise(F.lit(0.0))
    proj_pct = F.col("projected_total_tokens") / F.lit(token_limit) * 100
    ind = F.col("tokens_per_minute_for_indicator")
    return blocks.withColumns({
        "usage_percent": usage_pct,
        "burn_status": F.when(ind.isNull(), F.lit(None).cast("string"))
        .when(ind > BURN_HIGH, F.lit("HIGH")).when(ind > BURN_MODERATE, F.lit("MODERATE"))
        .otherwise(F.lit("NORMAL")),
        "usage_level": F.when(usage_pct > USAGE_RED, F.lit("red")).when(usage_pct > USAGE_YELLOW, F.lit("yellow"))
        .otherwise(F.lit("green")),
        "projection_status": F.when(F.col("projected_total_tokens").isNull() | (F.lit(token_limit) <= 0),
                                    F.lit(None).cast("string"))
        .when(proj_pct > PROJECTION_EXCEEDS, F.lit("EXCEEDS"))
        .when(proj_pct > PROJECTION_APPROACHING, F.lit("APPROACHING")).otherwise(F.lit("WITHIN")),
    })


def current_block(blocks: DataFrame, key=None) -> DataFrame:
    """The first active block (O6.4); ties on the start broken by the key."""
    return blocks.where(F.col("is_active")).orderBy("start_time", *key_list(key)).limit(1)


def active_block_detail(blocks: DataFrame, as_of, limit=None, key=None) -> DataFrame:
    """One row for the first active block: timing, usage, burn rate,
    projection and limit status (O5.13)."""
    cur = current_block(blocks, key)
    b = with_projection(with_burn_rate(cur), as_of)
    b = with_limit_status(b, limit, all_blocks=blocks)
    return b.select(
        *key_list(key), "block_id", "start_time", "end_time", "elapsed_minutes",
        minutes_between("end_time", F.lit(as_of).cast("timestamp")).alias("time_remaining_minutes"),
        "input_tokens", "output_tokens", "total_tokens", money_out("cost_usd").alias("cost_usd"),
        "tokens_per_minute", "cost_per_hour", "projected_total_tokens", "projected_total_cost",
        "token_limit", "remaining_tokens", "projected_percent", "limit_status")


def limit_status(limits: DataFrame) -> DataFrame:
    """Usage-limit tier level: > 60 yellow, > 90 red (O5.11)."""
    u = F.col("utilization")
    return limits.withColumn("level", F.when(u > 90, F.lit("red")).when(u > 60, F.lit("yellow"))
                             .otherwise(F.lit("green")))
