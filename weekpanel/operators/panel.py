"""Region x week panel: spine, case join, feature pivot, forward fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.operators.clean import fill_cases
from weekpanel.schemas import LAG_WEEKS, PANEL_KEYS, SPINE_WEEKS, VARIABLES, feature_columns


def year_range(cases_raw: DataFrame) -> tuple[Column, Column]:
    """Min and max ``Year`` of the raw case table, as scalar subqueries (no job runs
    here); NULL without any year, which gives an empty spine."""
    of = cases_raw.select(F.col("Year").cast("int").alias("Year"))
    return of.agg(F.min("Year")).scalar(), of.agg(F.max("Year")).scalar()


def weeks_in_year(year) -> F.Column:
    """52 or 53: the week of the Saturday before the next year's first Sunday."""
    from weekpanel.functions.calendar import week_number

    next_jan1 = F.make_date(year + 1, F.lit(1), F.lit(1))
    next_first_sunday = F.date_add(next_jan1, F.pmod(F.lit(8) - F.dayofweek(next_jan1), F.lit(7)))
    return week_number(F.date_sub(next_first_sunday, 1))


def week_spine(districts: DataFrame, start_year: int | Column | None, end_year: int | Column | None, weeks: int | str = SPINE_WEEKS) -> DataFrame:
    """Every ``(Year, Week, District)`` with weeks 1..``weeks``.

    ``weeks`` is a number (the original: 52 for every year) or
    ``'calendar'`` (52 or 53, as the first-Sunday calendar gives).
    Generated, not joined: each district row explodes a ``sequence`` of
    years and of weeks, so the spine is built where the district rows are
    and no cartesian product is planned.
    """
    last = weeks_in_year(F.col("Year")) if weeks == "calendar" else F.lit(int(weeks))
    first, final = (y if isinstance(y, Column) else F.lit(y) for y in (start_year, end_year))
    return (
        districts.select("District", first.cast("int").alias("__lo"), final.cast("int").alias("__hi"))
        .withColumn("Year", F.explode(F.sequence("__lo", "__hi")))
        .withColumn("Week", F.explode(F.sequence(F.lit(1), last)))
        .select("Year", "Week", "District")
    )


def complete_panel(cases: DataFrame, start_year: int | Column | None, end_year: int | Column | None, weeks: int | str = SPINE_WEEKS,
                   flag_reported: bool = False) -> DataFrame:
    """Spine of the case districts, left-joined with cases, missing cases -> 0.

    ``flag_reported`` adds ``was_reported`` (the week had a case row), which
    tells a true zero from a filled one.
    """
    districts = cases.select("District").distinct()
    spine = week_spine(districts, start_year, end_year, weeks)
    right = cases.select(*PANEL_KEYS, "Cases").withColumn("__reported", F.lit(True))
    joined = spine.join(right, PANEL_KEYS, "left")
    extra = [F.coalesce(F.col("__reported"), F.lit(False)).alias("was_reported")] if flag_reported else []
    return fill_cases(joined).select(*PANEL_KEYS, "Cases", *extra)


def features_wide(features: DataFrame, variables: list[str] | None = None, lags: list[int] | None = None) -> DataFrame:
    """Long features -> one row per ``(District, Year, Week)`` with ``{v}_lag{k}``.

    Each ``(variable, district, year, week)`` is unique, so the pivot is a
    single conditional aggregate (one partially aggregated shuffle; Spark's
    generic pivot would add a first grouping by variable).  The column list
    is fixed: a variable without a matched station still has its columns.
    """
    variables = variables or VARIABLES
    lags = lags or LAG_WEEKS
    aggs = [
        F.max(F.when(F.col("variable") == v, F.col(f"lag{k}"))).alias(f"{v}_lag{k}") for v in variables for k in lags
    ]
    return features.groupBy(
        F.col("district_name").alias("District"), F.col("year").alias("Year"), F.col("week").alias("Week")
    ).agg(*aggs)


def forward_fill(df: DataFrame, columns: list[str], partition: str = "District", order: list[str] | None = None) -> DataFrame:
    """Last non-missing value so far, per ``partition`` in ``order``; leading gaps stay.

    One window (one sort) serves every column.
    """
    order = order or ["Year", "Week"]
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {c: F.last(F.col(c), ignorenulls=True).over(w) for c in columns}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def integrate_panel(
    base: DataFrame, features: DataFrame, variables: list[str] | None = None, lags: list[int] | None = None
) -> DataFrame:
    """Left-join the pivoted features to the case panel, then forward fill.

    Replaces five left joins (one per variable) by one pivot and one join:
    every feature table is unique per ``(Year, Week, District)``, and all
    joins were left joins on those keys.
    """
    variables = variables or VARIABLES
    cols = feature_columns(variables, lags)
    wide = features_wide(features, variables, lags)
    joined = base.join(wide, PANEL_KEYS, "left")
    panel = joined.select(*PANEL_KEYS, F.coalesce(F.col("Cases"), F.lit(0.0)).alias("Cases"), *cols)
    return forward_fill(panel, cols)
