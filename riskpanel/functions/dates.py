"""Dates, months and time windows; months are also numbered so frames can be ranges."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """Date from the first ten characters of an ISO text; anything else is null."""
    head = F.substring(F.trim(text), 1, 10)
    return F.when(
        head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")
    ).when(head.rlike(r"^\d{8}$"), F.try_to_date(head, "yyyyMMdd"))


def iso_timestamp(text: Column) -> Column:
    """Timestamp from ISO-8601 text with an optional ``Z``; unparseable text is null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(trimmed))


def compact_date(text: Column) -> Column:
    """Strict ``YYYYMMDD``."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def month_key(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def month_key_from_text(text: Column) -> Column:
    """``YYYY-MM`` out of ``YYYY-MM…``, ``YYYYMM`` or a full timestamp text."""
    trimmed = F.trim(text)
    return (
        F.when(trimmed.rlike(r"^\d{6}$"), F.regexp_replace(trimmed, r"^(\d{4})(\d{2})$", "$1-$2"))
        .when(trimmed.rlike(r"^.{4}-.{2}"), F.substring(trimmed, 1, 7))
        .otherwise(month_key(iso_timestamp(trimmed)))
    )


def month_start(key: Column) -> Column:
    return F.try_to_date(F.concat(key, F.lit("-01")), "yyyy-MM-dd")


def month_number(moment: Column) -> Column:
    """Consecutive month number, so that month distances are plain subtraction."""
    return (F.year(moment) * 12 + F.month(moment) - 1).cast("int")


def month_number_of_key(key: Column) -> Column:
    return (
        F.substring(key, 1, 4).cast("int") * 12 + F.substring(key, 6, 2).cast("int") - 1
    ).cast("int")


def month_from_number(number: Column) -> Column:
    return F.make_date(F.floor(number / 12).cast("int"), (F.pmod(number, F.lit(12)) + 1)
                       .cast("int"), F.lit(1))


def add_month_key(key: Column, months: Column | int) -> Column:
    return month_key(F.add_months(month_start(key), months))


def duration_hours(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def is_weekend(moment: Column) -> Column:
    """Saturday or Sunday on the UTC clock."""
    return F.weekday(moment) >= 5


def is_late_night(moment: Column, offset_minutes: Column) -> Column:
    """Local hour 0-3; offsets floor to whole hours (minus 90 minutes is minus 2 hours)."""
    offset = F.coalesce(offset_minutes, F.lit(0)) / F.lit(60.0)
    local = F.pmod((F.hour(moment) + F.floor(offset)).cast("int"), F.lit(24))
    return local < 4


def commit_age_at(month_end: Column, visit_day: Column, days_before_visit: Column) -> Column:
    """Days from the last commit to a month end; the commit lies whole days before the visit."""
    commit_day = F.date_sub(visit_day, F.floor(days_before_visit).cast("int"))
    age = F.greatest(F.lit(0.0), F.datediff(month_end, commit_day).cast("double"))
    return F.when(days_before_visit.isNotNull() & visit_day.isNotNull(), age)


def months_between_keys(start: str, end: str) -> int:
    """Number of months in the inclusive range; checks the order of the two keys."""
    first, last = (date.fromisoformat(f"{key}-01") for key in (start, end))
    if first > last:
        raise ValueError("start month must be <= end month")
    return (last.year - first.year) * 12 + last.month - first.month + 1


def month_table(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per calendar month with its bounds, parts and grid-relative index."""
    count = months_between_keys(start, end)
    first = F.to_date(F.lit(f"{start}-01"))
    begin = F.add_months(first, F.col("id").cast("int"))
    return spark.range(0, count, 1, 1).select(
        month_key(begin).alias("month"),
        begin.alias("window_start"),
        F.last_day(begin).alias("window_end"),
        F.year(begin).alias("window_year"),
        F.month(begin).alias("window_month"),
        F.col("id").cast("int").alias("window_index"),
        month_number(begin).alias("month_no"),
    )


def calendar_window(as_of: Column) -> dict[str, Column]:
    """Window columns of a single point: months counted from January 2020."""
    return {
        "window_index": (month_number(as_of) - F.lit(2020 * 12)).cast("int"),
        "window_year": F.year(as_of),
        "window_month": F.month(as_of),
    }


def bucket_start(day: Column, first_day: Column, width: int) -> Column:
    """Start of the fixed-width bucket, anchored at ``first_day``, that holds ``day``."""
    if width <= 0:
        raise ValueError("bucket width must be > 0")
    steps = F.floor(F.datediff(day, first_day) / F.lit(width)).cast("int")
    return F.date_add(first_day, steps * F.lit(width))


def bucket_end(start: Column, last_day: Column, width: int) -> Column:
    return F.least(F.date_add(start, width - 1), last_day)


def date_buckets(spark: SparkSession, start: str, end: str, width: int) -> DataFrame:
    """Consecutive buckets of ``width`` days; the last one ends at ``end``."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    if width <= 0:
        raise ValueError("bucket width must be > 0")
    if last < first:
        raise ValueError("end date must be >= start date")
    count = (last - first).days // width + 1
    begin = F.date_add(F.to_date(F.lit(start)), (F.col("id") * width).cast("int"))
    return spark.range(count).select(
        begin.alias("bucket_start"),
        bucket_end(begin, F.to_date(F.lit(end)), width).alias("bucket_end"),
    )
