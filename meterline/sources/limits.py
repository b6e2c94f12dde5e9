"""Usage-limit snapshot source (O1.15) and tier levels (O5.11).

The snapshot is the JSON document of the limits service: four nullable
tiers, each ``{"utilization": number, "resets_at": RFC3339}``.  Files of
such documents are read as one row each and unpivoted with ``stack``;
NULL tiers are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions.timefns import reset_time_label

# fixed values: tier keys and their labels, in display order
TIERS = [
    ("five_hour", "Current session"),
    ("seven_day", "Current week (all models)"),
    ("seven_day_sonnet", "Current week (Sonnet only)"),
    ("seven_day_opus", "Current week (Opus only)"),
]
YELLOW_ABOVE = 60
RED_ABOVE = 90

_TIER = T.StructType([T.StructField("utilization", T.DoubleType()), T.StructField("resets_at", T.StringType())])
SNAPSHOT = T.StructType([T.StructField(k, _TIER) for k, _ in TIERS])


def limits_from_json(docs: DataFrame, col: str = "value") -> DataFrame:
    """Rows ``(tier, label, utilization, resets_at)`` from JSON documents."""
    parsed = docs.select(F.from_json(F.col(col), SNAPSHOT).alias("d"))
    args = ", ".join(f"'{k}', '{label}', d.{k}" for k, label in TIERS)
    rows = parsed.selectExpr(f"stack({len(TIERS)}, {args}) AS (tier, label, t)")
    return rows.where(F.col("t").isNotNull()).select(
        "tier", "label", F.col("t.utilization").alias("utilization"),
        F.try_to_timestamp(F.col("t.resets_at")).alias("resets_at"))


def load_limits(spark: SparkSession, path: str) -> DataFrame:
    """One snapshot document per file (O1.15)."""
    return limits_from_json(spark.read.text(path, wholetext=True))


def limit_status(limits: DataFrame, tz: str = "UTC", as_of=None) -> DataFrame:
    """Tier level: > 60 yellow, > 90 red; and the reset label (O5.11, O9.9)."""
    u = F.col("utilization")
    out = limits.withColumn("level", F.when(u > RED_ABOVE, F.lit("red")).when(u > YELLOW_ABOVE, F.lit("yellow"))
                            .otherwise(F.lit("green")))
    if as_of is not None:
        out = out.withColumn("reset_label", reset_time_label("resets_at", tz, as_of))
    return out
