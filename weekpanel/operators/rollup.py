"""Aggregations: weekly weather rollup and case totals.

All are single ``groupBy`` aggregates, partially aggregated map-side before
the shuffle, so a hot key (one station, one district) is reduced before it
reaches one task.  Sums are taken over decimals of ``scale`` places, so their last
bits do not depend on the order in which tasks deliver rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.functions.calendar import week_number, week_year
from weekpanel.functions.numeric import stable_mean, stable_sum
from weekpanel.schemas import SUM_SCALE, WEEKLY_AGG


def case_sum(scale: int | None = SUM_SCALE) -> Column:
    """The order-stable sum of ``Cases``, 0 when none is present."""
    return F.coalesce(stable_sum("Cases", scale), F.lit(0.0)).cast("double").alias("Cases")


def merge_districts(cases: DataFrame) -> DataFrame:
    """Sum ``Cases`` per ``(Year, Week, District)``; rows with a NULL key are
    dropped and an all-missing group sums to 0 (two source names that map to
    one district are merged here)."""
    keys = ["Year", "Week", "District"]
    valid = cases.filter(F.col("Year").isNotNull() & F.col("Week").isNotNull() & F.col("District").isNotNull())
    return valid.groupBy(*keys).agg(case_sum())


def weekly_rollup(obs: DataFrame, agg: dict[str, str] | str | None = None, empty_sum: str = "zero",
                  scale: int | None = SUM_SCALE) -> DataFrame:
    """Daily ``(variable, station, date, value)`` -> weekly ``(variable, station, year, week, value)``.

    ``agg`` maps variable -> ``'mean'`` (missing skipped; all missing ->
    NULL) or ``'sum'`` (all missing -> 0.0).  One ``groupBy`` serves every
    variable: both aggregates are computed and the variable picks one.
    ``scale`` is the number of decimal places that are summed exactly (None: doubles).
    """
    if agg is None:
        agg = WEEKLY_AGG
    if isinstance(agg, str):
        pick_sum = F.lit(agg == "sum")
    else:
        sums = [v for v, a in agg.items() if a == "sum"]
        pick_sum = F.col("variable").isin(sums) if sums else F.lit(False)
    d = F.to_date("date")
    dated = obs.select("variable", "station", week_year(d).alias("year"), week_number(d).alias("week"), "value")
    grouped = dated.groupBy("variable", "station", "year", "week").agg(
        stable_sum("value", scale).alias("__sum"), stable_mean("value", scale).alias("__avg")
    )
    empty = F.lit(0.0) if empty_sum == "zero" else F.lit(None).cast("double")
    value = F.when(pick_sum, F.coalesce(F.col("__sum"), empty)).otherwise(F.col("__avg"))
    return grouped.select("variable", "station", "year", "week", value.cast("double").alias("value"))


def national_by_year(cases: DataFrame) -> DataFrame:
    return cases.groupBy("Year").agg(case_sum())


def national_by_week(cases: DataFrame) -> DataFrame:
    return cases.groupBy("Year", "Week").agg(case_sum())


def cases_by_district(cases: DataFrame) -> DataFrame:
    return cases.groupBy("District").agg(case_sum())


def filtered_total(cases: DataFrame, predicate, name: str = "total") -> DataFrame:
    """One-row sum of ``Cases`` over rows matching ``predicate`` (0 when none)."""
    return cases.agg(F.coalesce(stable_sum(F.when(predicate, F.col("Cases")), SUM_SCALE), F.lit(0.0)).alias(name))
