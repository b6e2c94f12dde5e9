"""Time-key expressions (O2.1, O2.2, O9.5-O9.9).

Timestamps are Spark TIMESTAMP values in a UTC session; zone conversion is
done with ``from_utc_timestamp`` so a report zone never depends on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def local_time(ts, tz: str = "UTC") -> Column:
    """Wall-clock time of ``ts`` in zone ``tz``."""
    t = _c(ts)
    return t if tz in (None, "", "UTC") else F.from_utc_timestamp(t, tz)


def date_key(ts="ts", tz: str = "UTC") -> Column:
    """YYYY-MM-DD of the entry in the report zone (O2.1)."""
    return F.date_format(local_time(ts, tz), "yyyy-MM-dd")


def month_key(day_key="date_key") -> Column:
    """YYYY-MM = first 7 characters of the day key (O2.2)."""
    return F.substring(_c(day_key), 1, 7)


def floor_hour(ts="ts") -> Column:
    """Start of the hour (O9.5)."""
    return F.date_trunc("hour", _c(ts))


def week_start_first_monday(year: int, week: int) -> Column:
    """Start of week ``week`` of ``year`` where week 1 starts on the first
    Monday of the year (O9.6); UTC midnight."""
    jan1 = F.make_date(F.lit(year), F.lit(1), F.lit(1))
    first_monday = F.next_day(F.date_sub(jan1, 1), "Mon")
    return F.to_timestamp(F.date_add(first_monday, (week - 1) * 7))


def first_monday_week(ts="ts") -> Column:
    """(year, week) of the first-Monday week containing ``ts`` as a struct.

    The week starts on the Monday on or before the day; its number counts
    from the first Monday of the Monday's year.  Days before the first Monday
    of a year belong to the last week of the previous year.
    """
    monday = F.to_date(F.date_trunc("week", _c(ts)))
    return F.struct(F.year(monday).alias("year"),
                    (F.floor((F.dayofyear(monday) - 1) / 7) + 1).cast("int").alias("week"),
                    F.to_timestamp(monday).alias("week_start"))


def iso_week_key(ts="ts") -> Column:
    """ISO week key 'YYYY-Www' (O9.7, X3): the year is that of the week's Thursday."""
    d = F.to_date(_c(ts))
    iso_year = F.year(F.date_add(d, 3 - F.weekday(d)))
    return F.format_string("%d-W%02d", iso_year, F.weekofyear(d))


def minutes_between(later, earlier) -> Column:
    """Exact minutes between two timestamps, as a double."""
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / F.lit(60_000_000.0)


def reset_time_label(ts, tz: str, as_of) -> Column:
    """'Resets 2am (zone)' on the same local day as ``as_of``, otherwise
    'Resets Mar 13 at 10am (zone)'; zero minutes are dropped (O9.9)."""
    t = local_time(ts, tz)
    now = local_time(as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp"), tz)
    hour = F.regexp_replace(F.when(F.minute(t) == 0, F.date_format(t, "ha"))
                            .otherwise(F.date_format(t, "h:mma")), "AM|PM", "")
    suffix = F.lower(F.date_format(t, "a"))
    hour = F.concat(hour, suffix)
    zone = F.lit(tz or "UTC")
    same_day = F.to_date(t) == F.to_date(now)
    return F.when(t.isNull(), F.lit("")).when(
        same_day, F.concat(F.lit("Resets "), hour, F.lit(" ("), zone, F.lit(")"))
    ).otherwise(F.concat(F.lit("Resets "), F.date_format(t, "MMM d"), F.lit(" at "), hour,
                         F.lit(" ("), zone, F.lit(")")))
