"""Quality, reporting and reconciliation operators.

Every report is an aggregate computed by Spark; only its (small, bounded)
result is meant to be shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpanel.functions.numeric import rint2, stable_mean, stable_sum
from weekpanel.operators.util import qcol
from weekpanel.schemas import META_COLUMNS, STATION_GROUP, SUMMARY_STATS


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def null_counts(df: DataFrame) -> DataFrame:
    """``(ordinal, column, missing)`` for every column, in one pass."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(qcol(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    return wide.select(_stack([[F.lit(i + 1), F.lit(c), F.col(f"c{i}")] for i, c in enumerate(cols)]).alias("ordinal", "column", "missing"), "total")


def _stack(rows):
    """``stack`` of literal/column rows (one output row per inner list)."""
    return F.stack(F.lit(len(rows)), *[x for r in rows for x in r])


def completeness(df: DataFrame) -> DataFrame:
    """Columns with missing values: ``(ordinal, column, missing, missing_pct)``.

    Show it with ``orderBy(desc('missing'), 'ordinal')``; format the percent
    with :func:`percent_text`.
    """
    return null_counts(df).filter(F.col("missing") > 0).select(
        "ordinal", "column", "missing", (F.col("missing") * 100.0 / F.col("total")).alias("missing_pct")
    )


def percent_text(c, decimals: int = 2):
    return F.format_string(f"%.{decimals}f%%", F.col(c) if isinstance(c, str) else c)


SUMMARY_SCALE = 9  # decimal places that the means of a summary keep


def summary_long(panel: DataFrame, key: str = "District", scale: int | None = SUMMARY_SCALE) -> DataFrame:
    """``(key, column, count, mean, std, min, max)`` of every numeric column, not rounded.

    Columns become rows, and one aggregate of five mergeable moments serves them
    all: its size does not grow with the number of columns, and it is combined
    map-side, so what is shuffled is one row per task, key and column."""
    columns = [c for c in numeric_columns(panel) if c != key]
    long = panel.select(qcol(key).alias(key), *[qcol(c).cast("double").alias(c) for c in columns])
    long = long.unpivot([qcol(key)], [qcol(c) for c in columns], "column", "value")
    return long.groupBy(key, "column").agg(
        F.count("value").alias("count"), stable_mean("value", scale).alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def district_summary(panel: DataFrame, key: str = "District", stats: list[str] | None = None) -> DataFrame:
    """Per district ``count, mean, std, min, max`` of every numeric column,
    rounded to 2 decimals half-even; columns ``{col}_{stat}``: the rows of
    :func:`summary_long` side by side (one small aggregate into a map)."""
    stats = stats or SUMMARY_STATS
    rounded = [F.col("count") if s == "count" else rint2(s).alias(s) for s in SUMMARY_STATS]
    entry = F.struct("column", F.struct(*rounded).alias("of"))
    mapped = summary_long(panel, key).groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    return mapped.select(key, *[F.col("m")[c][s].alias(f"{c}_{s}") for c in numeric_columns(panel) if c != key for s in stats])


def join_coverage(joined: DataFrame, variables: list[str]) -> DataFrame:
    """Rows with a non-missing ``{v}_lag0`` after the feature join: ``(variable, filled, total, pct)``."""
    wide = joined.agg(F.count(F.lit(1)).alias("total"), *[F.count(f"{v}_lag0").alias(v) for v in variables])
    stack = _stack([[F.lit(v), F.col(v)] for v in variables])
    return wide.select(stack.alias("variable", "filled"), "total").withColumn("pct", F.col("filled") * 100.0 / F.col("total"))


def cell_completeness(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Non-missing cells over the weather columns: one row ``(filled, total, pct)``."""
    filled = sum((F.count(qcol(c)) for c in columns), F.lit(0))
    out = panel.agg(filled.alias("filled"), (F.count(F.lit(1)) * len(columns)).alias("total"))
    return out.withColumn("pct", F.col("filled") * 100.0 / F.col("total"))


def zero_weeks(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count_if(F.col("Cases") == 0).alias("zero_weeks"), F.count(F.lit(1)).alias("rows"))


def percentiles(df: DataFrame, columns: list[str], points: list[float]) -> DataFrame:
    """Exact interpolated percentiles: ``(column, p, value)``.

    Values are counted, dealt to range buckets, and counted up inside buckets
    and over the small table of bucket sizes, so no task holds a whole column
    and a value that fills a third of the rows is one row.  The two values
    around each percentile's rank are then picked and interpolated (the ranks, two
    rows per column and point, are broadcast)."""
    from weekpanel.session import materialize

    long = df.select(*[qcol(c).cast("double").alias(c) for c in columns]).unpivot([], [qcol(c) for c in columns], "column", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = materialize(counts.repartitionByRange("column", "value").withColumn("bucket", F.spark_partition_id()), "percentiles")
    over_buckets = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("column", "bucket").agg(F.sum("n").alias("size"))
    before = sizes.select("column", "bucket", F.coalesce(F.sum("size").over(over_buckets), F.lit(0)).alias("before"))
    inside = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("inside", F.sum("n").over(inside)).join(before, ["column", "bucket"]).select(
        "column", "value", (F.col("before") + F.col("inside") - F.col("n")).alias("first"), (F.col("before") + F.col("inside")).alias("end")
    )
    asked = ranged.groupBy("column").agg(F.sum("n").alias("total")).withColumn("p", F.explode(F.array(*[F.lit(p) for p in points])))
    asked = asked.withColumn("rank", (F.col("total") - 1) * F.col("p")).select(
        F.col("column").alias("of"), "p", "rank", F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("k")
    )
    found = placed.join(F.broadcast(asked), (F.col("column") == F.col("of")) & (F.col("k") >= F.col("first")) & (F.col("k") < F.col("end")))
    ends = found.groupBy("column", "p", "rank").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ends.select("column", "p", (F.col("lo") + (F.col("rank") - F.floor("rank")) * (F.col("hi") - F.col("lo"))).alias("value"))


def describe(df: DataFrame) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max of numeric columns (exact
    interpolated percentiles, like pandas).  Rows: ``statistic``; one column per input column."""
    cols = numeric_columns(df)
    stats = [
        ("count", lambda c: F.count(c).cast("double")),
        ("mean", lambda c: F.avg(c)),
        ("std", lambda c: F.stddev_samp(c)),
        ("min", lambda c: F.min(c).cast("double")),
        ("max", lambda c: F.max(c).cast("double")),
    ]
    wide = df.agg(*[fn(qcol(c)).alias(f"s{j}_{i}") for j, (s, fn) in enumerate(stats) for i, c in enumerate(cols)])
    rows = [[F.lit(s)] + [F.col(f"s{j}_{i}") for i in range(len(cols))] for j, (s, _) in enumerate(stats)]
    points = {0.25: "25%", 0.5: "50%", 0.75: "75%"}
    # a column without values still has its (empty) percentile rows
    names = df.sparkSession.createDataFrame([(p, s) for p, s in points.items()], "p double, statistic string")
    mid = names.join(percentiles(df, cols, list(points)), "p", "left").groupBy("statistic").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in cols]
    )
    return wide.select(_stack(rows).alias("statistic", *cols)).unionByName(mid)


def table_info(df: DataFrame) -> DataFrame:
    """``(ordinal, column, type, non_null)`` -- types from the schema, counts from one pass."""
    fields = df.schema.fields
    wide = df.agg(*[F.count(qcol(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = [[F.lit(i + 1), F.lit(f.name), F.lit(f.dataType.simpleString()), F.col(f"c{i}")] for i, f in enumerate(fields)]
    return wide.select(_stack(rows).alias("ordinal", "column", "type", "non_null"))


def station_catalog(spark: SparkSession, sheets: dict[str, list[DataFrame]], parts: list[int] | None = None, trim: bool = True) -> DataFrame:
    """``(station_group, variable, part, ordinal, station)``: the station headers of landed sheets.

    ``parts`` limits it to some parts (the original diagnostic looks at part 1 only) and
    ``trim=False`` keeps headers as landed.  Read from schemas: a row per column, no job."""
    rows = [
        (STATION_GROUP[v], v, p, i, c.strip() if trim else c)
        for v, of in sheets.items()
        for p, sheet in enumerate(of, 1)
        if parts is None or p in parts
        for i, c in enumerate((c for c in sheet.columns[1:] if c not in META_COLUMNS), 1)
    ]
    return spark.createDataFrame(rows, "station_group string, variable string, part int, ordinal int, station string")


def group_catalog(catalog: DataFrame) -> DataFrame:
    """The catalog of one variable per station group: of the temperatures the one that sorts first
    (``temp_max``), so that a group's stations count once."""
    speaker = catalog.groupBy("station_group").agg(F.min("variable").alias("variable"))
    return catalog.join(speaker, ["station_group", "variable"], "left_semi")


def panel_extent(panel: DataFrame) -> DataFrame:
    """Shape, key extent, districts and total cases in one aggregate."""
    return panel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(panel.columns)).alias("columns"),
        F.min("Year").alias("min_year"),
        F.min("Week").alias("min_week"),
        F.max("Year").alias("max_year"),
        F.max("Week").alias("max_week"),
        F.count_distinct("District").alias("districts"),
        stable_sum("Cases").alias("total_cases"),
    )


def top_n(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    """First ``n`` rows by ``by`` descending, ``tie`` ascending (distributed top-k)."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(n)


def first_n_per_group(df: DataFrame, group: str, order: list[str], n: int, buckets: int = 32) -> DataFrame:
    """Up to ``n`` rows per group in ``order``, with ``position``, the group's ``total`` and ``more``.

    Exact and skew-safe: a group is split into ``buckets`` hash buckets, each
    keeps its own first ``n`` (windows over one bucket), and only those
    candidates (at most ``n * buckets`` per group) are ranked again per group.
    The totals come from a partially aggregated count, so no task ever holds
    a whole group, however large.
    """
    salted = df.withColumn("__bucket", F.pmod(F.hash(*[F.col(c) for c in order]), F.lit(buckets)))
    local = Window.partitionBy(group, "__bucket").orderBy(*order)
    candidates = salted.withColumn("__r", F.row_number().over(local)).filter(F.col("__r") <= n).drop("__r", "__bucket")
    ranked = candidates.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    totals = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    top = ranked.filter(F.col("position") <= n).join(totals, group)
    return top.withColumn("more", F.greatest(F.col("total") - n, F.lit(0)))


def reconcile_totals(raw: DataFrame, panel: DataFrame, key: str = "District", max_week: int | None = None) -> DataFrame:
    """Raw vs panel case totals per district: ``(District, raw_total, panel_total, passed)``.

    ``raw`` must already carry the cleaned name in ``key``.  Full outer join;
    a district missing on one side fails.  Week-53 cases are in the raw total
    but not in the panel, so such districts fail by design; ``max_week=52``
    compares only the weeks the panel keeps.
    """
    if max_week is not None:
        raw = raw.filter(F.col("Week") <= max_week)
    r = raw.groupBy(key).agg(F.coalesce(stable_sum("Cases"), F.lit(0.0)).alias("raw_total"))
    p = panel.groupBy(key).agg(stable_sum("Cases").alias("panel_total"))
    j = r.join(p, key, "full")
    return j.withColumn("passed", F.coalesce(F.col("raw_total") == F.col("panel_total"), F.lit(False)))


def reconcile_week(raw: DataFrame, panel: DataFrame, key: str = "District") -> DataFrame:
    """For each district, its first raw (Year, Week) group: raw sum vs panel value.
    Rows with a NULL key belong to no group (a NULL would sort first)."""
    raw = raw.dropna(subset=[key, "Year", "Week"])
    sums = raw.groupBy(key, "Year", "Week").agg(F.coalesce(stable_sum("Cases"), F.lit(0.0)).alias("raw_cases"))
    first = sums.groupBy(key).agg(F.min(F.struct("Year", "Week", "raw_cases")).alias("f")).select(
        key, F.col("f.Year").alias("Year"), F.col("f.Week").alias("Week"), F.col("f.raw_cases").alias("raw_cases")
    )
    p = panel.groupBy(key, "Year", "Week").agg(stable_sum("Cases").alias("panel_cases"))
    j = first.join(p, [key, "Year", "Week"], "left")
    return j.withColumn("panel_cases", F.coalesce("panel_cases", F.lit(0.0))).withColumn(
        "passed", F.col("raw_cases") == F.col("panel_cases")
    )


def week_drilldown(series: DataFrame, weeks: int = 2) -> DataFrame:
    """Weeks 1..``weeks`` of the first year of one daily series ``(date, value)``:
    day range, day count, values present, their sum and mean, and the values
    themselves in day order (at most seven)."""
    from weekpanel.functions.calendar import week_number, week_year

    d = F.to_date("date")
    dated = series.select(week_year(d).alias("year"), week_number(d).alias("week"), d.alias("day"), "value")
    first_year = dated.agg(F.min("year").alias("fy"))
    sel = dated.join(F.broadcast(first_year), F.col("year") == F.col("fy")).filter(F.col("week") <= weeks)
    return sel.groupBy("year", "week").agg(
        F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"),
        F.count(F.lit(1)).alias("days"),
        F.count("value").alias("n_values"),
        stable_sum("value").alias("value_sum"),
        stable_mean("value").alias("value_mean"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "value"))), lambda x: x["value"].cast("string")), ", ").alias("daily_values"),
    )
