"""Date and time functions on dates and TIMESTAMP_NTZ; all parts come as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["date_trunc", "date_part", "age_days", "epoch"]

_UNITS = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")


def date_trunc(unit: str, ts: Column) -> Column:
    """The start of the unit as TIMESTAMP_NTZ.  Weeks start on Monday, centuries in years ending in 01; an unknown unit leaves ts as it is."""
    unit, ts = unit.lower(), ts.cast("timestamp_ntz")
    first = lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    year = F.year(ts)
    if unit == "decade":
        return first(F.floor(year / 10) * 10)
    if unit == "century":
        return first(F.floor((year - 1) / 100) * 100 + 1)
    if unit == "millennium":
        return first(F.floor((year - 1) / 1000) * 1000 + 1)
    return F.date_trunc(unit, ts).cast("timestamp_ntz") if unit in _UNITS else ts


def epoch(ts: Column) -> Column:
    """Seconds since 1970, with fractions."""
    return F.unix_micros(ts.cast("timestamp_ntz").cast("timestamp")) / F.lit(1e6)


def date_part(field: str, ts: Column) -> Column:
    """year, quarter, month, week (ISO), day, doy, dow (0: Sunday), isodow, hour, minute, second, milliseconds, microseconds, epoch, decade, century or millennium."""
    field, ts = field.lower().rstrip("s") if field.lower() not in ("milliseconds", "microseconds") else field.lower(), ts.cast("timestamp_ntz")
    year = F.year(ts)
    second = F.date_part(F.lit("second"), ts).cast("double")
    parts = {
        "year": year, "quarter": F.quarter(ts), "month": F.month(ts), "week": F.weekofyear(ts), "day": F.dayofmonth(ts), "doy": F.dayofyear(ts),
        "dow": F.dayofweek(ts) - 1, "isodow": F.weekday(ts) + 1, "hour": F.hour(ts), "minute": F.minute(ts), "second": second,
        "milliseconds": second * 1e3, "microseconds": second * 1e6, "epoch": epoch(ts), "decade": F.floor(year / 10),
        "century": F.floor((year - 1) / 100) + 1, "millennium": F.floor((year - 1) / 1000) + 1,
    }
    if field not in parts:
        raise ValueError(f"unknown field {field}")
    return parts[field].cast("double")


def age_days(later: Column, earlier: Column | None = None) -> Column:
    """Whole days between two timestamps; with one argument, from it to now."""
    a, b = (later, earlier) if earlier is not None else (F.localtimestamp(), later)
    return F.timestamp_diff("DAY", b.cast("timestamp_ntz"), a.cast("timestamp_ntz")).cast("long")
