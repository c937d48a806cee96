"""Reshape: melt wide case tables, pivots, wide sheets <-> long observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.functions.numeric import stable_sum
from weekpanel.operators.util import qcol


def melt_cases(wide: DataFrame, id_col: str = "period", var_name: str = "District", value_name: str = "Cases") -> DataFrame:
    """``(period, <district>...)`` -> ``(period, District, Cases)``; missing cells stay as NULL rows."""
    cols = [c for c in wide.columns if c != id_col]
    long = wide.unpivot([id_col], [qcol(c) for c in cols], var_name, value_name)
    return long.withColumn(value_name, F.col(value_name).cast("double"))


def cases_long_from_wide(wide: DataFrame, id_col: str = "period") -> DataFrame:
    """Wide case table -> ``(Year, Week, District, Cases)``.

    The period text is parsed once per period row BEFORE the unpivot (same
    result, one regex per period instead of one per cell).
    """
    from weekpanel.operators.clean import extract_period

    with_period = extract_period(wide, id_col)
    cols = [c for c in wide.columns if c != id_col]
    long = with_period.unpivot(["Year", "Week"], [qcol(c) for c in cols], "District", "Cases")
    return long.select("Year", "Week", "District", F.col("Cases").cast("double").alias("Cases"))


def pivot_sum(cases: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """``row`` x ``column`` table of summed ``Cases``, missing -> 0.  ``values``
    fixes the column list (stable schema, no distinct job); a value outside it is an
    error, since its sums would vanish.  Rows without a ``column`` value belong to none."""
    sums = [F.coalesce(stable_sum(F.when(F.col(column) == v, F.col("Cases"))), F.lit(0.0)).alias(str(v)) for v in values]
    out = cases.groupBy(row).agg(*sums, F.max(F.when(~F.col(column).isin(values), F.col(column).cast("string"))).alias("__other"))
    failed = F.raise_error(F.concat(F.lit(f"{column} is not among the columns of the pivot: "), "__other")).cast("double")
    checked = F.when(F.col("__other").isNull(), qcol(str(values[0]))).otherwise(failed).alias(str(values[0]))
    return out.select(row, checked, *[qcol(str(v)) for v in values[1:]])


def pivot_year_district(cases: DataFrame, districts: list[str]) -> DataFrame:
    return pivot_sum(cases, "Year", "District", districts)


def pivot_district_year(cases: DataFrame, years: list[int]) -> DataFrame:
    return pivot_sum(cases, "District", "Year", years)
