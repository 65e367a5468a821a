"""String, number and date functions as Postgres defines them, where Spark's differ or are missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: date_part() names that Spark's own function extracts.
SPARK_PARTS = ("day", "doy", "hour", "minute", "month", "quarter", "week", "year")


def substr(s: Column, start: Column | int, length: Column | int) -> Column:
    """Characters start to start + length - 1, from 1; places before 1 count but hold nothing; a negative length is null."""
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    first = F.greatest(start, F.lit(1))
    return F.when(length < 0, None).otherwise(F.substring(s, first, F.greatest(start + length - first, F.lit(0))))


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates; a divisor of 0 is an error, as in ANSI mode."""
    return F.call_function("div", a, b)


def btrim(s: Column, chars: str = " ") -> Column:
    return F.btrim(s, F.lit(chars))


def ltrim(s: Column, chars: str = " ") -> Column:
    return F.ltrim(s, F.lit(chars))


def rtrim(s: Column, chars: str = " ") -> Column:
    return F.rtrim(s, F.lit(chars))


def like(s: Column, pattern: str) -> Column:
    """The built-in like() of the engine this follows: without regard to case."""
    return s.ilike(pattern)


def date_part(part: str, ts: Column) -> Column:
    """The part as a double; null for a part that isn't known. Sunday is 0; seconds have their fraction."""
    year, second = F.year(ts), F.date_part(F.lit("second"), ts).cast("double")
    own = {
        "century": F.ceil(year / 100), "decade": F.floor(year / 10), "millennium": F.ceil(year / 1000), "dow": F.dayofweek(ts) - 1,
        "second": second, "millisecond": second * 1000, "microsecond": second * 1_000_000,
    }
    if part in own:
        return own[part].cast("double")
    return F.date_part(F.lit(part), ts).cast("double") if part in SPARK_PARTS else F.lit(None).cast("double")


def date_trunc(part: str, ts: Column) -> Column:
    """ts, a timestamp without zone, cut to the part, whatever the session's zone; null for a part that isn't known.

    A century and a millennium begin in the year that ends 01 of those years that end 00 to 99: 2000 goes to 2001.
    """
    years = {"decade": lambda y: y - y % 10, "century": lambda y: y - y % 100 + 1, "millennium": lambda y: y - y % 1000 + 1}
    if part in years:
        return F.make_timestamp_ntz(years[part](F.year(ts)), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    if part in ("year", "quarter", "month", "week"):
        return F.trunc(ts.cast("date"), part).cast("timestamp_ntz")
    if part == "day":
        return ts.cast("date").cast("timestamp_ntz")
    second, zero = F.date_part(F.lit("second"), ts), F.lit(0)
    digits = {"second": 0, "millisecond": 3, "microsecond": 6}
    times = {"hour": (F.hour(ts), zero, zero), "minute": (F.hour(ts), F.minute(ts), zero)}
    if part in digits:
        times[part] = F.hour(ts), F.minute(ts), F.floor(second * 10 ** digits[part]).cast("decimal(8,0)") / F.lit(10 ** digits[part]).cast("decimal(8,0)")
    if part not in times:
        return F.lit(None).cast("timestamp_ntz")
    h, m, s = times[part]
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), h, m, s.cast("decimal(16,6)"))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    days = F.unix_date(ts.cast("date")).cast("long")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (days * 86_400 + seconds) * 1_000_000 + (F.date_part(F.lit("second"), ts) * 1_000_000).cast("long")


def to_date(s: Column) -> Column:
    """A date from Y-M-D or Y/M/D; null where month or day don't exist."""
    return F.try_to_date(F.replace(s, F.lit("/"), F.lit("-")), "yyyy-M-d")


def julian_day(d: Column) -> Column:
    return F.unix_date(d) + 2440588


def from_julian_day(n: Column) -> Column:
    return F.date_from_unix_date(n - 2440588)
