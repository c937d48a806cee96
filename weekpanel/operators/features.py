"""Station -> district mapping, lagged weekly features, mapping diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.functions.text import normalize_code, standardize_mapping_name, strip_ws, title_case
from weekpanel.operators.clean import keep_first
from weekpanel.schemas import LAG_WEEKS, STATION_GROUP

GROUP_COLUMNS = sorted(set(STATION_GROUP.values()))


def prepare_mapping(mapping: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Standardize mapping names and keep the first row per name (file order).

    Needs ``src_row``; codes are normalized to stripped text.
    """
    std = mapping.withColumn("district_name", standardize_mapping_name("district_name", aliases)).withColumn(
        "district_code", normalize_code("district_code")
    )
    return keep_first(std, ["district_name"], ["src_row"])


def mapping_long(mapping: DataFrame) -> DataFrame:
    """``(district_code, district_name, station_group, station)``, one row per
    district and station column.  NULL stations are kept (they never match)."""
    groups = [g for g in GROUP_COLUMNS if g in mapping.columns]
    return mapping.unpivot(["district_code", "district_name"], groups, "station_group", "station")


def variable_groups():
    """variable -> station column of the mapping, as a literal map expression."""
    return F.create_map(*[F.lit(x) for kv in STATION_GROUP.items() for x in kv])


def week_index(year, week):
    """Weeks since the first Sunday of 1970 (1970-01-04) of a first-Sunday ``(year, week)``."""
    jan1 = F.make_date(year, F.lit(1), F.lit(1))
    first_sunday = F.date_add(jan1, F.pmod(F.lit(8) - F.dayofweek(jan1), F.lit(7)))
    start = F.date_add(first_sunday, (week - 1) * 7)
    return (F.datediff(start, F.lit("1970-01-04").cast("date")) / 7).cast("long")


def lag_weekly(weekly: DataFrame, lags: list[int] | None = None, by: str = "rows") -> DataFrame:
    """``{lag0..lagK}`` of each station's weekly series.

    ``by='rows'`` (the original behaviour): the k-th previous row in
    ``(year, week)`` order.  Rows are dense per variable (the rollup keeps a
    row for every week of the variable), so this is the k-th previous week
    present in the table.  ``by='calendar'``: the value exactly k calendar
    weeks earlier (NULL if that week has no row), via a range frame on a
    week index.
    """
    lags = lags or LAG_WEEKS
    if by == "rows":
        w = Window.partitionBy("variable", "station").orderBy("year", "week")
        cols = [(F.col("value") if k == 0 else F.lag("value", k).over(w)).alias(f"lag{k}") for k in lags]
        return weekly.select("variable", "station", "year", "week", *cols)
    if by != "calendar":
        raise ValueError(f"by must be 'rows' or 'calendar', not {by!r}")
    indexed = weekly.withColumn("__widx", week_index(F.col("year"), F.col("week")))
    base = Window.partitionBy("variable", "station").orderBy("__widx")
    cols = [
        (F.col("value") if k == 0 else F.first("value").over(base.rangeBetween(-k, -k))).alias(f"lag{k}") for k in lags
    ]
    return indexed.select("variable", "station", "year", "week", *cols)


def lag_features(weekly: DataFrame, mapping: DataFrame, lags: list[int] | None = None, by: str = "rows") -> DataFrame:
    """Weekly station series -> district features ``(variable, district_name, year, week, lag0..)``.

    Lags are taken once per station, then joined to every district that uses
    the station (the per-variable station column of the mapping).  Districts
    whose station is absent contribute no rows.  The mapping side is a
    dimension; AQE turns the join into a broadcast at run time when its
    measured size allows (no extra sizing job).  District names get the
    strip + title normalization the features table receives before joining.
    """
    lagged = lag_weekly(weekly, lags, by)
    groups = variable_groups()
    with_group = lagged.withColumn("station_group", F.element_at(groups, F.col("variable")))
    ml = mapping_long(mapping).filter(F.col("station").isNotNull()).select(
        title_case(strip_ws(F.col("district_name").cast("string"))).alias("district_name"), "station_group", "station"
    )
    joined = with_group.join(ml, ["station_group", "station"], "inner")
    lag_cols = [c for c in lagged.columns if c.startswith("lag")]
    return joined.select("variable", "district_name", "year", "week", *lag_cols)


def unmatched_stations(mapping: DataFrame, stations: dict[str, list[str]]) -> DataFrame:
    """``(variable, district_name, station, missing)`` for every variable and mapped district: whether the
    district's station is absent from that variable's data.  The mean temperature has the max table's stations."""
    known = {**stations, "temp": stations.get("temp_max", [])}
    rows = [(v, g, known.get(v, [])) for v, g in STATION_GROUP.items()]
    data = mapping.sparkSession.createDataFrame(rows, "variable string, station_group string, known array<string>")
    matched = F.coalesce(F.array_contains("known", F.col("station")), F.lit(False))
    return mapping_long(mapping).join(F.broadcast(data), "station_group").select("variable", "district_name", "station", (~matched).alias("missing"))


def missing_stations(mapping: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mapping stations absent from the data, per station group.

    ``catalog`` has ``(station_group, station)``.  Left-anti join; a NULL
    station never matches, so it is reported missing.
    """
    ml = mapping_long(mapping)
    return ml.join(catalog.select("station_group", "station").distinct(), ["station_group", "station"], "left_anti")
