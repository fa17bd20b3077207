"""Date parts, differences and month arithmetic; every function accepts both timestamp types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def dow_sunday0(col: Column) -> Column:
    return F.dayofweek(col) - 1


def dow_monday0(col: Column) -> Column:
    return F.weekday(col)


def weekday_name(col: Column) -> Column:
    return F.date_format(col, "EEEE")


def month_label(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def days_between(start: Column, end: Column) -> Column:
    """Midnights passed from `start` to `end`."""
    return F.datediff(F.to_date(end), F.to_date(start))


def month_start(col: Column) -> Column:
    return F.trunc(F.to_date(col), "MM")


def months_between_int(start: Column, end: Column) -> Column:
    """Month boundaries passed from `start` to `end`."""
    return (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))


def fractional_days(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(float(MICROS_PER_DAY))


def days_to_four_places(later: Column, earlier: Column) -> Column:
    """`fractional_days` rounded half-up to four places, for spans that aren't negative; whole numbers, since decimals cost ten times as much a row."""
    step = MICROS_PER_DAY // 10_000
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return F.call_function("div", micros + F.lit(step // 2), F.lit(step)) / F.lit(10_000.0)


def whole_days(later: Column, earlier: Column) -> Column:
    """Completed 24-hour spans, floored (negative spans too); not the number of midnights."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("long")


def month_end_list(first: Column, last: Column) -> Column:
    """Array of the month-end dates within [first, last]."""
    months = F.sequence(month_start(first), month_start(last), F.expr("interval 1 month"))
    ends = F.transform(months, lambda m: F.last_day(m))
    return F.filter(ends, lambda e: (e >= F.to_date(first)) & (e <= F.to_date(last)))


def month_ends(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per month end within [first, last]."""
    bounds = spark.range(1).select(F.lit(first).cast("date").alias("a"), F.lit(last).cast("date").alias("b"))
    return bounds.select(F.explode(month_end_list(F.col("a"), F.col("b"))).alias("month_end"))


def calendar_features(df: DataFrame, date: str) -> DataFrame:
    """Weekday (Monday 0), day, month, quarter, ISO week and weekend flag."""
    day = F.col(date)
    return df.withColumns(
        {
            "day_of_week": dow_monday0(day),
            "day_of_month": F.dayofmonth(day),
            "month": F.month(day),
            "quarter": F.quarter(day),
            "week_of_year": F.weekofyear(day),
            "is_weekend": (dow_monday0(day) >= 5).cast("int"),
        }
    )
