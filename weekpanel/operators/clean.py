"""Cleaning operators: headers, numbers, names, codes, period text, fills, keep-first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpanel.functions.numeric import coerce_double
from weekpanel.functions.text import (
    extract_period_week,
    extract_period_year,
    normalize_code,
    standardize_mapping_name,
    standardize_name,
)
from weekpanel.operators.util import qcol


def trim_columns(df: DataFrame) -> DataFrame:
    """Strip whitespace around every column name (values untouched)."""
    return df.toDF(*[c.strip() for c in df.columns])


def coerce_numeric(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Every column not in ``exclude`` -> DOUBLE; unparsable cells -> NULL."""
    exclude = set(exclude or [])
    return df.select(
        *[
            qcol(f.name) if f.name in exclude else coerce_double(qcol(f.name), f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )


def standardize_names(
    df: DataFrame, col: str = "District", aliases: dict[str, str] | None = None, strip_code: bool = True
) -> DataFrame:
    """Replace ``col`` with its standardized district name."""
    return df.withColumn(col, standardize_name(col, aliases, strip_code=strip_code))


def standardize_mapping(df: DataFrame, aliases: dict[str, str] | None = None, col: str = "district_name") -> DataFrame:
    return df.withColumn(col, standardize_mapping_name(col, aliases))


def normalize_codes(df: DataFrame, col: str = "district_code") -> DataFrame:
    return df.withColumn(col, normalize_code(col))


def extract_period(df: DataFrame, period_col: str = "period") -> DataFrame:
    """Add ``Year``/``Week`` from period text such as ``W40 2025Sun 2025``."""
    return df.withColumn("Year", extract_period_year(period_col)).withColumn("Week", extract_period_week(period_col))


def fill_cases(df: DataFrame, col: str = "Cases") -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(0.0)))


def fill_all(df: DataFrame) -> DataFrame:
    """Missing -> 0 in every column; text columns get the text ``'0'``."""
    out = df.na.fill(0)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return out.na.fill("0", strings) if strings else out


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``: the one with the smallest ``order`` tuple.

    ``min`` over a struct that starts with the order columns picks the whole
    first row.  Unlike a window, this is a partially aggregated ``groupBy``:
    a key holding a third of all rows is reduced map-side before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*[qcol(c) for c in order + rest])).alias("__first")
    out = df.groupBy(*[qcol(k) for k in keys]).agg(packed)
    return out.select(*[qcol(k) for k in keys], *[F.col("__first").getField(c).alias(c) for c in order + rest]).select(
        *[qcol(c) for c in df.columns]
    )


def dedup_mapping(mapping: DataFrame, key: str = "district_name", order: str = "src_row") -> DataFrame:
    """Drop mapping rows whose (standardized) district name was seen earlier in file order."""
    return keep_first(mapping, [key], [order])


def filter_contains(df: DataFrame, col: str, pattern: str, regex: bool = False) -> DataFrame:
    """Case-sensitive substring (or regex) test; NULL -> no match."""
    test = F.col(col).rlike(pattern) if regex else F.col(col).contains(pattern)
    return df.filter(F.coalesce(test, F.lit(False)))


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def filter_week(df: DataFrame, district: str, year: int, week: int) -> DataFrame:
    return df.filter((F.col("District") == district) & (F.col("Year") == year) & (F.col("Week") == week))
