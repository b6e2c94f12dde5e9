"""The priced, deduplicated, named usage facts every report starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.operators.dedup import dedup_usage
from meterline.operators.names import session_names, with_session_name
from meterline.operators.pricing import with_cost
from meterline.sources.events_view import VIEW_ORDER, usage_name_rows, usage_view


def view_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_names(usage_name_rows(spark, sf_dir), line_order=["ts", "line_seq"])


def priced_usage(spark: SparkSession, sf_dir: str, prices: DataFrame | None = None,
                 names: bool = True) -> DataFrame:
    """events -> usage view -> keep-first dedup -> cost -> session names."""
    df = with_cost(dedup_usage(usage_view(spark, sf_dir), order=VIEW_ORDER), prices)
    if names:
        df = with_session_name(df, view_names(spark, sf_dir))
    return df


def joined(col, sep: str = ";") -> F.Column:
    """Array shown as one sorted, joined string (the CSV export form)."""
    return F.array_join(F.sort_array(F.col(col) if isinstance(col, str) else col), sep)


def map_joined(col) -> F.Column:
    """Map shown as 'k=v' pairs sorted by key, joined by ';'."""
    c = F.col(col)
    return F.array_join(F.transform(F.sort_array(F.map_entries(c)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
