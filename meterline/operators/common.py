"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterline.schema import MONEY

def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonempty(c) -> Column:
    """Go's "" means missing: NULL and '' are treated the same."""
    x = col(c)
    return x.isNotNull() & (x != "")


def blank_to_null(c) -> Column:
    x = col(c)
    return F.when(x != "", x)


def money_out(c) -> Column:
    """Exact decimal money rounded to 6 places and shown as double."""
    return F.round(col(c).cast(MONEY), 6).cast("double")


def sum0(c) -> Column:
    return F.coalesce(F.sum(col(c)), F.lit(0))


def order_struct(cols: list[str]) -> Column:
    """Sort key with NULLs last for every column, usable in min()/max()."""
    fields = []
    for i, c in enumerate(cols):
        fields.append(F.col(c).isNull().alias(f"_n{i}"))
        fields.append(F.col(c).alias(f"_v{i}"))
    return F.struct(*fields)


def key_list(key) -> list[str]:
    if key is None:
        return []
    if isinstance(key, str):
        return [key]
    return list(key)
