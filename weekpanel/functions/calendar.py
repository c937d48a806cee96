"""First-Sunday week calendar.

Week 1 of a year starts on its first Sunday; days before it belong to the last
week of the year before, so weeks run 1..52 or 1..53.  Closed form: take the
Sunday on or before the day; its year is the week's year and its day of year
gives the week, ``floor((doy - 1) / 7) + 1``.  No per-row loop, no lookup
table, fully inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_date(c: Column | str) -> Column:
    return F.to_date(F.col(c) if isinstance(c, str) else c)


def week_start(d: Column | str) -> Column:
    """The Sunday on or before ``d`` (``dayofweek``: Sunday = 1)."""
    day = _as_date(d)
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_year(d: Column | str) -> Column:
    return F.year(week_start(d))


def week_number(d: Column | str) -> Column:
    return (F.floor((F.dayofyear(week_start(d)) - 1) / 7) + 1).cast("int")


def with_week(df: DataFrame, date_col: str = "date", year_col: str = "year", week_col: str = "week") -> DataFrame:
    """Add ``(year, week)`` of the first-Sunday calendar for ``date_col``."""
    return df.withColumn(year_col, week_year(date_col)).withColumn(week_col, week_number(date_col))


def calendar_trace(df: DataFrame, date_col: str = "date") -> DataFrame:
    """The calendar's intermediate values for each date (the worked trace).

    ``jan_1_weekday`` uses Monday = 0; ``days_since_first_sunday`` is negative
    for days that fall into the previous year's last week.
    """
    d = _as_date(date_col)
    jan1 = F.make_date(F.year(d), F.lit(1), F.lit(1))
    to_sunday = F.pmod(F.lit(6) - F.weekday(jan1), F.lit(7))
    first_sunday = F.date_add(jan1, to_sunday)
    return df.select(
        d.alias("date"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.year(d).alias("calendar_year"),
        jan1.alias("jan_1"),
        F.weekday(jan1).alias("jan_1_weekday"),
        to_sunday.cast("int").alias("days_until_sunday"),
        first_sunday.alias("first_sunday"),
        (d < first_sunday).alias("before_first_sunday"),
        F.datediff(d, first_sunday).alias("days_since_first_sunday"),
        week_year(d).alias("year"),
        week_number(d).alias("week"),
    )
