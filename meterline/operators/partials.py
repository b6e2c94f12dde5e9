"""Day partial aggregates: rows that reports add up instead of facts
(O4.1-O4.3, O4.10, O8.6, O10.8).

A partial is one row per day of a zone, session and model with the number of
entries ``n`` and the sums of the measures.  Partials add: those of two sets of
entries, or of entries and later corrections (``sign`` -1), merge by sums.  A
session counts for a day as long as its ``n`` there is above zero, so distinct
counts stay exact under retractions.  Entries without a valid time have a null
day: they count in the totals and in no day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.timefns import date_key, month_key
from meterline.operators.common import money_out
from meterline.operators.filters import valid_time
from meterline.operators.reports import SKETCH_LG_K, period_sums, session_sketch

KEYS = ["date_key", "session_id", "model"]
TOKENS = ["input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens", "total_tokens"]
COSTS = ["api_cost", "cache_create_cost", "cache_read_cost", "cost"]
SUMS = ["n", *TOKENS, *COSTS]
SCHEMA = "date_key string, session_id string, model string, n long, " + ", ".join(f"{c} long" for c in TOKENS) + ", " + \
    ", ".join(f"{c} decimal(38,12)" for c in COSTS)


def day_partials(entries: DataFrame, tz: str = "UTC") -> DataFrame:
    """Partials of priced entries; a column ``sign`` (1 or -1), if there is one,
    adds or takes off its row."""
    minus = F.col("sign") < 0 if "sign" in entries.columns else F.lit(False)

    def signed(value, kind):
        value = F.coalesce(value, F.lit(0)).cast(kind)
        return F.when(minus, -value).otherwise(value).cast(kind)

    valid = F.col("ts").isNotNull() & (F.year("ts") >= 2020)
    return merge_partials(entries.select(
        F.when(valid, date_key("ts", tz)).alias("date_key"), "session_id", "model", signed(F.lit(1), "long").alias("n"),
        *[signed(F.col(c), "long").alias(c) for c in TOKENS], *[signed(F.col(c), "decimal(38,12)").alias(c) for c in COSTS]))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partials added up; what cancels out altogether is gone."""
    kinds = {c: "decimal(38,12)" if c in COSTS else "long" for c in SUMS}
    some = F.lit(False)
    for c in SUMS:
        some = some | (F.col(c) != 0)
    return partials.groupBy(*KEYS).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in SUMS]).where(some)


def daily_from_partials(partials: DataFrame, with_total: bool = False) -> DataFrame:
    """``reports.daily_report`` without reading a fact."""
    return period_sums(_days(partials), "date_key", F.col("date_key"), True, with_total)


def monthly_from_partials(partials: DataFrame, with_total: bool = False) -> DataFrame:
    """``reports.monthly_report`` without reading a fact."""
    return period_sums(_days(partials), "month_key", month_key("date_key"), False, with_total)


def totals_from_partials(partials: DataFrame) -> DataFrame:
    """``reports.usage_totals`` without reading a fact."""
    return partials.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_requests"),
                        money_out(F.coalesce(F.sum("cost"), F.lit(0))).alias("total_cost"),
                        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"))


def _days(partials: DataFrame) -> DataFrame:
    return merge_partials(partials).where("n > 0 and date_key is not null")


# ---- sketches: a bounded row per day and model ---------------------------------

def _united():
    return F.hll_sketch_estimate(F.hll_union_agg("sketch"))


def day_sketches(entries: DataFrame, tz: str = "UTC", lg_k: int = SKETCH_LG_K) -> DataFrame:
    """One row per day and model: ``n``, the sums and the sketch ``sessions``.

    Its size follows days and models, whatever the number of sessions.  Tables of
    disjoint entries add up (``merge_sketches``); unlike partials they cannot take
    an entry off, so they are made from deduplicated entries."""
    kinds = {c: "decimal(38,12)" if c in COSTS else "long" for c in SUMS}
    return valid_time(entries).withColumns({"date_key": date_key("ts", tz), "n": F.lit(1)}).groupBy("date_key", "model").agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).cast(kinds[c]).alias(c) for c in SUMS], session_sketch(lg_k).alias("sessions"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketch tables of disjoint entries, united row-wise, as one table."""
    kinds = {c: "decimal(38,12)" if c in COSTS else "long" for c in SUMS}
    return sketches.groupBy("date_key", "model").agg(
        *[F.sum(c).cast(kinds[c]).alias(c) for c in SUMS], F.hll_union_agg("sessions").alias("sessions"))


def daily_from_sketches(sketches: DataFrame, with_total: bool = False) -> DataFrame:
    """``reports.daily_report(approx=True)`` without reading a fact."""
    return period_sums(sketches.withColumnRenamed("sessions", "sketch"), "date_key", F.col("date_key"), True, with_total, sessions=_united())


def monthly_from_sketches(sketches: DataFrame, with_total: bool = False) -> DataFrame:
    """``reports.monthly_report(approx=True)`` without reading a fact."""
    return period_sums(sketches.withColumnRenamed("sessions", "sketch"), "month_key", month_key("date_key"), False, with_total, sessions=_united())
