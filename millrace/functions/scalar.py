"""The scalar function library as Column expressions: all of them stay inside code generation, none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def upper(s) -> Column:
    """Of the letters a-z only."""
    return F.translate(_c(s), _LOW, _UP)


def lower(s) -> Column:
    """Of the letters A-Z only."""
    return F.translate(_c(s), _UP, _LOW)


def length(s) -> Column:
    """Number of code points, as a 64-bit integer."""
    return F.char_length(_c(s)).cast("bigint")


def substr(s, start, count=None) -> Column:
    """Characters from place start (1 is the first, -1 the last, 0 stands before the first and takes up one character).

    A negative count gives characters before start. Null if any argument is.
    """
    s, start = _c(s), _c(start).cast("bigint")
    n = F.char_length(s)
    place = F.when(start < 0, n + start + 1).otherwise(start)
    if count is None:
        return F.substring(s, F.greatest(place, F.lit(1)).cast("int"), F.lit(2**31 - 1))
    count = _c(count).cast("bigint")
    ahead = F.substring(s, F.greatest(place, F.lit(1)).cast("int"), F.greatest(count - F.greatest(1 - place, F.lit(0)), F.lit(0)).cast("int"))
    end = F.least(F.greatest(place - 1, F.lit(0)), n)
    begin = F.greatest(end + count, F.lit(0))
    behind = F.substring(s, (begin + 1).cast("int"), (end - begin).cast("int"))
    return F.when(count >= 0, ahead).when(count < 0, behind)


def replace(s, old, new) -> Column:
    return F.replace(_c(s), _c(old), _c(new))


def trim(s) -> Column:
    """Without spaces (U+0020 only) at both ends."""
    return F.trim(_c(s))


def absolute(x) -> Column:
    return F.abs(_c(x))


def round_half_away(x, digits=0) -> Column:
    """x * 10^d rounded half away from zero, over 10^d; a double. A fractional d is truncated; d over 308 gives x, under -308 gives 0."""
    x, d = _c(x).cast("double"), _c(digits).cast("bigint")
    scale = F.pow(F.lit(10.0), d)
    return F.when(d > 308, x).when(d < -308, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def floor(x) -> Column:
    return F.floor(_c(x)).cast("double")


def ceil(x) -> Column:
    return F.ceil(_c(x)).cast("double")


def now() -> Column:
    """The time of the query in UTC, without a zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))


def date(x) -> Column:
    return _c(x).cast("date")


def year(x) -> Column:
    return F.year(_c(x)).cast("bigint")


def month(x) -> Column:
    return F.month(_c(x)).cast("bigint")


def day(x) -> Column:
    return F.dayofmonth(_c(x)).cast("bigint")


def hour(x) -> Column:
    return F.hour(_c(x)).cast("bigint")


def minute(x) -> Column:
    return F.minute(_c(x)).cast("bigint")


def second(x) -> Column:
    return F.second(_c(x)).cast("bigint")


#: Units of date_trunc and datediff, and those that a DATE can be cut to.
UNITS = ("year", "month", "day", "hour", "minute", "second")
CALENDAR_UNITS = ("year", "month", "day")


def date_trunc(unit: str, x, is_date: bool = False) -> Column:
    """x cut to the unit; a DATE stays a DATE (calendar units only), a TIMESTAMP stays one."""
    unit = unit.lower()
    if unit not in (CALENDAR_UNITS if is_date else UNITS):
        raise ValueError(f"date_trunc: unit {unit} is not supported here")
    return F.date_trunc(unit, _c(x)).cast("date" if is_date else "timestamp_ntz")


def datediff(unit: str, a, b) -> Column:
    """b - a in whole units, towards zero.

    Months are those of the calendar, less one (towards zero) if what is behind b's month start is less than behind a's.
    """
    unit = unit.lower()
    if unit not in UNITS:
        raise ValueError(f"datediff: unit {unit} is not supported")
    a, b = _c(a).cast("timestamp_ntz"), _c(b).cast("timestamp_ntz")
    if unit not in ("month", "year"):
        return F.timestamp_diff(unit.upper(), a, b)
    months = ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")
    tail = lambda x: F.timestamp_diff("MICROSECOND", F.date_trunc("month", x).cast("timestamp_ntz"), x)
    full = F.when((months > 0) & (tail(b) < tail(a)), months - 1).when((months < 0) & (tail(b) > tail(a)), months + 1).otherwise(months)
    return full if unit == "month" else F.call_function("div", full, F.lit(12).cast("bigint"))


def divide(a, b, integers: bool) -> Column:
    """a / b: of integers truncated towards zero, and null where b is zero."""
    a, b = _c(a), _c(b)
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))) if integers else F.try_divide(a, b)


def add_interval(x, interval: str, is_date: bool = False) -> Column:
    """x + interval ('1 month', '-25 hours'); months clamp to the month's end, a DATE stays a DATE."""
    number, unit = interval.split()
    parts = {"years": 0, "months": 0, "days": 0, "hours": 0, "mins": 0, "secs": 0}
    name = {"year": "years", "month": "months", "day": "days", "hour": "hours", "minute": "mins", "second": "secs"}[unit.rstrip("s")]
    parts[name] = int(number)
    moved = _c(x).cast("timestamp_ntz") + F.make_interval(years=F.lit(parts["years"]), months=F.lit(parts["months"]), days=F.lit(parts["days"]), hours=F.lit(parts["hours"]), mins=F.lit(parts["mins"]), secs=F.lit(parts["secs"]))
    return moved.cast("date") if is_date else moved


def like(s, pattern: str) -> Column:
    """%, _ and no escape character; case-sensitive."""
    return _c(s).like(pattern.replace("\\", "\\\\"))


def coalesce(*xs) -> Column:
    return F.coalesce(*map(_c, xs))
