"""Local calendar keys and calendar attributes as columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_time(ts: Column, zone: str) -> Column:
    """A UTC instant (session zone UTC) as wall-clock time in an IANA zone, daylight saving included."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def local_date_key(ts: Column, zone: str) -> Column:
    return F.to_date(local_time(ts, zone))


def local_time_key(ts: Column, zone: str) -> Column:
    return F.date_format(local_time(ts, zone), "HH:00")


def last_complete_day(now: Column, zone: str) -> Column:
    return F.date_sub(local_date_key(now, zone), 1)


def calendar_columns(d: Column) -> dict[str, Column]:
    """Calendar attributes of a date; weeks are ISO weeks, and the week key has the ISO week's year."""
    year, month, quarter = F.year(d), F.month(d), F.quarter(d)
    half = F.when(month <= 6, 1).otherwise(2)
    half_start = F.make_date(year, F.when(half == 1, 1).otherwise(7), F.lit(1))
    quarter_start = F.trunc(d, "quarter")
    return {
        "year": year, "quarter": quarter, "month": month, "day_of_month": F.dayofmonth(d), "day_of_week": F.weekday(d) + 1,
        "week_of_year": F.weekofyear(d), "day_of_quarter": F.datediff(d, quarter_start) + 1, "day_of_year": F.dayofyear(d),
        "day_of_half": F.datediff(d, half_start) + 1, "week_of_quarter": F.floor(F.datediff(d, quarter_start) / 7).cast("int") + 1,
        "month_of_quarter": (month - 1) % 3 + 1, "month_of_half": (month - 1) % 6 + 1, "is_weekend": F.weekday(d) >= 5,
        "week_key": F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)), "month_key": F.date_format(d, "yyyy-MM"),
        "quarter_key": F.format_string("%d-Q%d", year, quarter), "year_key": year.cast("string"), "half_key": F.format_string("%d-H%d", year, half),
    }


def with_calendar(df: DataFrame, date_col: str) -> DataFrame:
    return df.select("*", *[c.alias(name) for name, c in calendar_columns(F.col(date_col)).items()])


def date_dimension(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per day from first to last, both included."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date_key"))
    return with_calendar(days, "date_key")


def hour_columns(hour: Column, core_start: int = 9, core_end: int = 17) -> dict[str, Column]:
    """Attributes of an hour of the day; core hours are start <= hour < end."""
    bucket = F.when(hour < 6, "Night").when(hour < 12, "Morning").when(hour < 18, "Afternoon").otherwise("Evening")
    return {
        "time_key": F.format_string("%02d:00", hour), "hour_12": F.pmod(hour + 11, F.lit(12)) + 1,
        "am_pm": F.when(hour < 12, "AM").otherwise("PM"), "time_bucket": bucket, "is_core_hours": (hour >= core_start) & (hour < core_end),
    }


def month_windows(start: Column, end: Column) -> Column:
    """Array of (start, end): the months from start to end, clipped to both."""
    firsts = F.sequence(F.trunc(start, "month"), end, F.expr("interval 1 month"))
    return F.when(start <= end, F.transform(firsts, lambda m: F.struct(F.greatest(start, m.cast("date")).alias("start"), F.least(end, F.last_day(m)).alias("end")))).otherwise(F.array().cast("array<struct<start:date,end:date>>"))
