"""Row filters (O2.*).  Plain ``where`` predicates that Catalyst pushes below
projections and joins, down to the parquet scan where the column allows."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.timefns import date_key, local_time


def _ts(value) -> F.Column:
    return F.lit(value).cast("timestamp") if not isinstance(value, F.Column) else value


def valid_time(df: DataFrame) -> DataFrame:
    """Timestamp present and year >= 2020 (O2.13, O1.9)."""
    return df.where(F.col("ts").isNotNull() & (F.year("ts") >= 2020))


def filter_range(df: DataFrame, start, end) -> DataFrame:
    """Half-open ``[start, end)`` on ``ts`` (O2.3)."""
    return df.where((F.col("ts") >= _ts(start)) & (F.col("ts") < _ts(end)))


def filter_day(df: DataFrame, day: str, tz: str = "UTC") -> DataFrame:
    """``[day 00:00, +24h)`` in zone ``tz`` (O2.4)."""
    start = datetime.strptime(normalize_day(day), "%Y-%m-%d")
    s = F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    e = F.lit((start + timedelta(days=1)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    if tz not in (None, "", "UTC"):
        s, e = F.to_utc_timestamp(s, tz), F.to_utc_timestamp(e, tz)
    return filter_range(df, s, e)


def normalize_day(value: str) -> str:
    """Accept YYYYMMDD or YYYY-MM-DD; raise on anything else."""
    v = value.strip()
    if re.fullmatch(r"\d{8}", v):
        v = f"{v[:4]}-{v[4:6]}-{v[6:]}"
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", v):
        raise ValueError(f"bad day {value!r}: use YYYYMMDD or YYYY-MM-DD")
    datetime.strptime(v, "%Y-%m-%d")
    return v


def normalize_month(value: str) -> str:
    """Accept YYYYMM or YYYY-MM; raise on anything else."""
    v = value.strip()
    if re.fullmatch(r"\d{6}", v):
        v = f"{v[:4]}-{v[4:]}"
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", v):
        raise ValueError(f"bad month {value!r}: use YYYYMM or YYYY-MM")
    return v


def _local_midnight_utc(day: str, tz: str | None) -> F.Column:
    t = F.lit(f"{day} 00:00:00").cast("timestamp")
    return t if tz in (None, "", "UTC") else F.to_utc_timestamp(t, tz)


def ts_bounds(since_day: str | None, until_day_exclusive: str | None, tz: str | None) -> F.Column:
    """The same range as a predicate on the raw ``ts`` column, which the
    parquet reader can push down (row-group and partition pruning)."""
    cond = F.lit(True)
    if since_day:
        cond = cond & (F.col("ts") >= _local_midnight_utc(since_day, tz))
    if until_day_exclusive:
        cond = cond & (F.col("ts") < _local_midnight_utc(until_day_exclusive, tz))
    return cond


def filter_days(df: DataFrame, since: str | None = None, until: str | None = None,
                key: str = "date_key", tz: str | None = None) -> DataFrame:
    """Inclusive day-key range, string compare (O2.5).  With ``tz`` the range
    is also stated on ``ts`` so it reaches the scan."""
    cond = F.lit(True)
    s = normalize_day(since) if since else None
    u = normalize_day(until) if until else None
    if s:
        cond = cond & (F.col(key) >= s)
    if u:
        cond = cond & (F.col(key) <= u)
    if tz is not None and (s or u):
        nxt = (datetime.strptime(u, "%Y-%m-%d") + timedelta(days=1)).strftime("%Y-%m-%d") if u else None
        cond = cond & ts_bounds(s, nxt, tz)
    return df.where(cond)


def filter_months(df: DataFrame, since: str | None = None, until: str | None = None,
                  key: str = "month_key", tz: str | None = None) -> DataFrame:
    """Inclusive month-key range (O2.6); with ``tz`` also stated on ``ts``."""
    cond = F.lit(True)
    s = normalize_month(since) if since else None
    u = normalize_month(until) if until else None
    if s:
        cond = cond & (F.col(key) >= s)
    if u:
        cond = cond & (F.col(key) <= u)
    if tz is not None and (s or u):
        nxt = None
        if u:
            y, m = int(u[:4]), int(u[5:])
            nxt = f"{y + (m == 12):04d}-{(m % 12) + 1:02d}-01"
        cond = cond & ts_bounds(f"{s}-01" if s else None, nxt, tz)
    return df.where(cond)


def filter_until_day(df: DataFrame, since: str | None, until: str | None, as_of) -> DataFrame:
    """``[since, until + 1 day)``; default ``until`` = ``as_of``; a bad since
    means open, a bad until means ``as_of`` (O2.7)."""
    start = None
    if since:
        try:
            start = datetime.strptime(since, "%Y-%m-%d")
        except ValueError:
            start = None
    end = None
    if until:
        try:
            end = datetime.strptime(until, "%Y-%m-%d") + timedelta(days=1)
        except ValueError:
            end = None
    end_col = F.lit(end.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp") if end else _ts(as_of)
    cond = F.col("ts") < end_col
    if start:
        cond = cond & (F.col("ts") >= F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"))
    return df.where(cond)


def filter_session_id(df: DataFrame, session_id: str | None) -> DataFrame:
    """Session id equality; empty = no filter (O2.8)."""
    return df if not session_id else df.where(F.col("session_id") == session_id)


def filter_session_name(df: DataFrame, name: str | None) -> DataFrame:
    """Session name equality; empty = no filter (O2.9)."""
    return df if not name else df.where(F.col("session_name") == name)


def recent_blocks(blocks: DataFrame, as_of, days: int = 3) -> DataFrame:
    """Blocks starting after ``as_of - days`` (O2.10)."""
    cutoff = _ts(as_of) - F.make_interval(days=F.lit(days))
    return blocks.where(F.col("start_time") > cutoff)


def active_blocks(blocks: DataFrame) -> DataFrame:
    """Active blocks only (O2.11)."""
    return blocks.where(F.col("is_active"))


def filter_sessions_activity(sessions: DataFrame, since: str | None, until: str | None,
                             tz: str = "UTC") -> DataFrame:
    """Session rows whose last activity, as 'yyyy-MM-dd HH:mm' in ``tz``,
    is within the inclusive string range (O2.12)."""
    act = F.date_format(local_time("last_activity", tz), "yyyy-MM-dd HH:mm")
    cond = F.lit(True)
    if since:
        cond = cond & (act >= since)
    if until:
        cond = cond & (act <= until)
    return sessions.where(cond)
