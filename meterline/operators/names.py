"""Session names (O3.2, O3.3).

Inside one file the last custom title wins, else the first agent name; across
files the first file in load order that names the session wins.  Both levels
are aggregates over small structs, partial on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators.common import order_struct

FILE_ORDER = ["file_first_ts", "source_file"]
LINE_ORDER = ["file_block_start", "line_seq"]


def session_names(name_rows: DataFrame, line_order: list[str] = LINE_ORDER,
                  file_order: list[str] = FILE_ORDER) -> DataFrame:
    """``(session_id, session_name)`` from session-name lines."""
    is_title = F.col("kind") == "title"
    per_file = (name_rows
                .groupBy("session_id", "source_file")
                .agg(F.max(F.when(is_title, F.struct(order_struct(line_order).alias("o"),
                                                     F.col("name").alias("name")))).alias("_t"),
                     F.min(F.when(~is_title, F.struct(order_struct(line_order).alias("o"),
                                                      F.col("name").alias("name")))).alias("_a"),
                     F.min("file_first_ts").alias("file_first_ts"))
                .select("session_id", "source_file", "file_first_ts",
                        F.coalesce(F.col("_t.name"), F.col("_a.name")).alias("name")))
    return (per_file.where(F.col("name").isNotNull())
            .groupBy("session_id")
            .agg(F.min(F.struct(order_struct(file_order).alias("o"), F.col("name").alias("n")))
                 .alias("_f"))
            .select("session_id", F.col("_f.n").alias("session_name")))


def with_session_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """Back-fill the session name on every entry of the session (O3.3).

    The names table has one row per named session; the planner chooses the
    join by its size.
    """
    out = df.join(names.select("session_id", F.col("session_name").alias("_sn")), "session_id", "left")
    if "session_name" in df.columns:
        out = out.withColumn("session_name", F.coalesce("_sn", "session_name")).drop("_sn")
    else:
        out = out.withColumnRenamed("_sn", "session_name")
    return out.select(*df.columns, *([] if "session_name" in df.columns else ["session_name"]))
