"""Clock texts, relative dates and exact rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(text: Column) -> Column:
    """``HH:MM:SS,mmm`` or with a point, as seconds; null if it isn't one."""
    part = lambda k: F.regexp_extract(text, r"^\s*(\d+):(\d{1,2}):(\d{1,2}(?:[.,]\d+)?)\s*$", k)
    return F.when(part(1) != "", part(1).cast("int") * 3600 + part(2).cast("int") * 60 + F.replace(part(3), F.lit(","), F.lit(".")).cast("double"))


def clock_text(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``."""
    return F.format_string("%02d:%02d:%06.3f", F.floor(seconds / 3600).cast("int"), (F.floor(seconds / 60) % 60).cast("int"), seconds % 60)


def clock_range(start: Column, end: Column) -> Column:
    return F.concat(clock_text(start), F.lit(" --> "), clock_text(end))


def minutes_text(seconds: Column) -> Column:
    """``MM:SS.mmm`` with milliseconds cut off."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d.%03d", F.floor(whole / 60).cast("int"), (whole % 60).cast("int"), F.floor((seconds - whole) * 1000).cast("int"))


def relative_date(text: Column, as_of) -> Column:
    """Minutes or hours ago: the day itself; n days ago: so many before; anything else stays."""
    days = F.regexp_extract(text, r"(\d+)일", 1)
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    today = F.lit(as_of).cast("date")
    return F.when(text.contains("분") | text.contains("시간"), day(today)).when(days != "", day(F.date_sub(today, F.coalesce(days.try_cast("int"), F.lit(0))))).otherwise(text)


def iso_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def two_digits(month: Column) -> Column:
    return F.lpad(month.cast("string"), 2, "0")
