"""Strict numbers and times: what a cast would forgive is rejected by a pattern first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_int(text: Column) -> Column:
    """The whole field is digits with an optional minus, or null."""
    return F.when(text.rlike(r"^-?[0-9]{1,18}$"), text.try_cast("long"))


def strict_double(text: Column) -> Column:
    """A plain decimal number with an optional exponent, or null; no signs of plus, no blanks, no NaN."""
    return F.when(text.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def civil_days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a proleptic Gregorian date; a day past the end of its month rolls over."""
    return F.datediff(F.date_add(F.make_date(year, month, F.lit(1)), (day - 1).cast("int")), F.lit("1970-01-01").cast("date"))


def _seconds(days: Column, hour: Column, minute: Column, second: Column) -> Column:
    return (days.cast("long") * 86400 + hour * 3600 + minute * 60 + second).cast("double")


CSV_TIME = r"^[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}$"
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def _valid(month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)


def _at(text: Column, *places: tuple[int, int]) -> list[Column]:
    """Numbers of so many digits at fixed places."""
    return [F.substr(text, F.lit(at), F.lit(n)).try_cast("int") for at, n in places]


def csv_time(text: Column) -> Column:
    """Unix seconds of `DD/MM/YYYY HH:MM:SS`, or null."""
    day, month, year, hour, minute, second = _at(F.when(text.rlike(CSV_TIME), text), (1, 2), (4, 2), (7, 4), (12, 2), (15, 2), (18, 2))
    good = _valid(month, day, hour, minute, second) & (year >= 1)
    return F.when(good, _seconds(civil_days(year, F.when(good, month).otherwise(1), day), hour, minute, second))


def iso_time(text: Column) -> Column:
    """Unix seconds of an ISO-8601 time with a zone, its fraction up to nine digits, or null."""
    whole = F.when(text.rlike(ISO_TIME), text)
    year, month, day, hour, minute, second = _at(whole, (1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))
    off_h, off_m = _at(F.right(whole, F.lit(5)), (1, 2), (4, 2))
    sign = F.when(F.left(F.right(whole, F.lit(6)), F.lit(1)) == "-", -1).otherwise(1)
    utc = whole.endswith("Z")
    zone = F.when(utc, 0).otherwise(sign * (off_h * 3600 + off_m * 60))
    digits = F.substr(F.regexp_extract(whole, r"\.([0-9]+)", 1), F.lit(1), F.lit(9))
    fraction = F.when(digits != "", F.concat(F.lit("0."), digits).cast("double")).otherwise(0.0)
    good = _valid(month, day, hour, minute, second) & (year >= 1) & (utc | ((off_h <= 23) & (off_m <= 59)))
    days = _seconds(civil_days(year, F.when(good, month).otherwise(1), day), hour, minute, second)
    return F.when(good, days - zone + fraction)
