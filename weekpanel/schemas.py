"""Schemas, variable lists and fixed values of the panel model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the original pipeline's for identical results.
# ---------------------------------------------------------------------------

# Lags of every weekly weather variable (current week + four weeks before).
LAG_WEEKS = [0, 1, 2, 3, 4]

# District name aliases, applied to the upper-cased, stripped name.
DISTRICT_ALIASES = {
    "ARGHAKHANCHI": "Arghakhachi",
    "CHITAWAN": "Chitwan",
    "DHANUSA": "Dhanusha",
    "KAPILBASTU": "Kapilvastu",
    "KAVREPALANCHOK": "Kavrepalanchowk",
    "SINDHUPALCHOK": "Sindhupalchowk",
    "SOLUKHUMBU": "Sholukhumbu",
    "NAWALPARASI EAST": "Nawalparasi",
    "NAWALPARASI WEST": "Nawalparasi",
}

# Upper-cased names that are kept upper-case instead of being title-cased.
KEEP_UPPER = ["EAST", "WEST"]

# Time formats tried in order on daily sheets; the first that parses any row
# is used for the whole sheet (Spark datetime patterns).
DATE_FORMATS = ["d/M/yyyy H:m:s", "d/M/yyyy"]

# Period text pattern on wide case tables: week number, then a 4-digit year.
PERIOD_PATTERN = r"W([0-9]+)\s+([0-9]{4})"

# Weeks of the panel spine (week 53 is never in the spine).
SPINE_WEEKS = 52

# Weather variables in panel column order, their station column in the
# mapping, and their weekly aggregate.
VARIABLES = ["temp", "temp_max", "temp_min", "humidity", "precipitation"]
STATION_GROUP = {
    "temp": "temp_station",
    "temp_max": "temp_station",
    "temp_min": "temp_station",
    "humidity": "humidity_station",
    "precipitation": "precipitation_station",
}
WEEKLY_AGG = {
    "temp": "mean",
    "temp_max": "mean",
    "temp_min": "mean",
    "humidity": "mean",
    "precipitation": "sum",
}

# Decimal places that sums of readings and cases keep exactly (order-stable sums).
SUM_SCALE = 6

# Summary statistics per district, in output order.
SUMMARY_STATS = ["count", "mean", "std", "min", "max"]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

CASES = T.StructType(
    [
        T.StructField("Year", T.IntegerType()),
        T.StructField("Week", T.IntegerType()),
        T.StructField("District", T.StringType()),
        T.StructField("Cases", T.DoubleType()),
    ]
)

MAPPING = T.StructType(
    [
        T.StructField("district_code", T.StringType()),
        T.StructField("district_name", T.StringType()),
        T.StructField("temp_station", T.StringType()),
        T.StructField("humidity_station", T.StringType()),
        T.StructField("precipitation_station", T.StringType()),
    ]
)


def feature_columns(variables: list[str] | None = None, lags: list[int] | None = None) -> list[str]:
    """``{v}_lag{k}`` in panel order."""
    return [f"{v}_lag{k}" for v in (variables or VARIABLES) for k in (lags or LAG_WEEKS)]


PANEL_KEYS = ["Year", "Week", "District"]


def panel_schema(variables: list[str] | None = None) -> T.StructType:
    fields = list(CASES.fields) + [T.StructField(c, T.DoubleType()) for c in feature_columns(variables)]
    return T.StructType(fields)


PANEL = panel_schema()

# Reserved columns carried by landed wide sheets next to the station columns.
META_COLUMNS = ["variable", "part", "src_row"]
