"""Panel, summary, diagnostics and reconciliation (FIXTURES B8-B10) plus properties."""

from pyspark.sql import functions as F

from weekpanel.operators import quality as Q
from weekpanel.operators.clean import dedup_mapping, keep_first, standardize_names
from weekpanel.operators.features import missing_stations
from weekpanel.operators.panel import complete_panel
from weekpanel.operators.rollup import merge_districts


def test_district_summary(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 4.0), ("B", 7.0)], "District string, Cases double")
    got = {r.District: (r.Cases_count, r.Cases_mean, r.Cases_std, r.Cases_min, r.Cases_max) for r in Q.district_summary(df).collect()}
    assert got == {"A": (3, 2.33, 1.53, 1.0, 4.0), "B": (1, 7.0, None, 7.0, 7.0)}


def test_missing_stations(spark):
    mapping = spark.createDataFrame(
        [("d1", "D1", "s1", "s1", "s1"), ("d2", "D2", None, "s1", "s1"), ("d3", "D3", "zz", "s1", "s1")],
        "district_code string, district_name string, temp_station string, humidity_station string, precipitation_station string",
    )
    catalog = spark.createDataFrame([("temp_station", "s1"), ("humidity_station", "s1"), ("precipitation_station", "s1")],
                                    "station_group string, station string")
    got = sorted((r.district_code, r.station) for r in missing_stations(mapping, catalog).collect())
    assert got == [("d2", None), ("d3", "zz")]


def raw_cases(spark, extra=()):
    rows = [(2020, 1, "NAWALPARASI EAST", 3.0), (2020, 1, "NAWALPARASI WEST", 4.0), (2020, 2, "101 KATHMANDU", None)]
    return spark.createDataFrame(rows + list(extra), "Year int, Week int, District string, Cases double")


def test_reconciliation(spark):
    raw = standardize_names(raw_cases(spark))
    panel = complete_panel(merge_districts(raw), 2020, 2020)
    rec = {r.District: (r.raw_total, r.panel_total, r.passed) for r in Q.reconcile_totals(raw, panel).collect()}
    assert rec["Nawalparasi"] == (7.0, 7.0, True)
    raw53 = standardize_names(raw_cases(spark, [(2023, 53, "NAWALPARASI EAST", 5.0)]))
    panel53 = complete_panel(merge_districts(raw53), 2020, 2023)
    rec = {r.District: (r.raw_total, r.panel_total, r.passed) for r in Q.reconcile_totals(raw53, panel53).collect()}
    assert rec["Nawalparasi"] == (12.0, 7.0, False)  # week 53 never reaches the 52-week spine
    wk = {r.District: (r.Year, r.Week, r.raw_cases, r.panel_cases, r.passed) for r in Q.reconcile_week(raw, panel).collect()}
    assert wk["Nawalparasi"] == (2020, 1, 7.0, 7.0, True)


def test_spine_shape_and_conservation(spark):
    raw = standardize_names(raw_cases(spark, [(2021, 52, "X", 2.0), (2021, 53, "X", 9.0), (None, 3, "X", 1.0)]))
    merged = merge_districts(raw)
    panel = complete_panel(merged, 2020, 2021)
    n_d = merged.select("District").distinct().count()
    assert panel.count() == 2 * 52 * n_d
    assert panel.groupBy("Year", "Week", "District").count().filter("count > 1").count() == 0
    raw_total = merged.agg(F.sum("Cases")).first()[0]
    wk53 = merged.filter("Week = 53").agg(F.sum("Cases")).first()[0]
    assert panel.agg(F.sum("Cases")).first()[0] == raw_total - wk53
    assert Q.zero_weeks(panel).first().zero_weeks == panel.count() - 2  # only Nawalparasi 2020 w1 and X 2021 w52 have cases


def test_keep_first_and_dedup_mapping(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, "only")], "k string, src_row long, v string")
    got = {r.k: r.v for r in keep_first(df, ["k"], ["src_row"]).collect()}
    assert got == {"a": "early", "b": "only"}
    m = spark.createDataFrame([("Nawalparasi", 3), ("Nawalparasi", 1)], "district_name string, src_row long")
    assert dedup_mapping(m).first().src_row == 1


def test_completeness_and_describe(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "x", None), (3, "y", None)], "a int, b string, c double")
    got = {r.column: (r.missing, round(r.missing_pct, 4)) for r in Q.completeness(df).collect()}
    assert got == {"b": (1, 33.3333), "c": (2, 66.6667)}
    d = {r.statistic: r.a for r in Q.describe(df).collect()}
    assert (d["count"], d["mean"], d["25%"], d["50%"], d["75%"], d["max"]) == (3.0, 2.0, 1.5, 2.0, 2.5, 3.0)
    info = [(r.column, r.type, r.non_null) for r in Q.table_info(df).orderBy("ordinal").collect()]
    assert info == [("a", "int", 3), ("b", "string", 2), ("c", "double", 1)]


def test_first_n_per_group(spark):
    df = spark.createDataFrame([("g", i) for i in range(15)] + [("h", 1)], "grp string, o int")
    got = Q.first_n_per_group(df, "grp", ["o"], 10).groupBy("grp").agg(F.count("*").alias("n"), F.max("more").alias("more"))
    assert {r.grp: (r.n, r.more) for r in got.collect()} == {"g": (10, 5), "h": (1, 0)}


def test_first_n_per_group_hot_group_exact(spark):
    """One group holding most rows: the bucketed top-n equals a plain sort."""
    rows = [("hot", i, f"x{i}") for i in range(5000)] + [("cold", i, f"y{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "grp string, o int, v string")
    got = Q.first_n_per_group(df, "grp", ["o"], 10, buckets=16)
    hot = [(r.position, r.o, r.total, r.more) for r in got.filter("grp = 'hot'").orderBy("position").collect()]
    assert hot == [(i + 1, i, 5000, 4990) for i in range(10)]
    assert got.filter("grp = 'cold'").count() == 7


def test_lag_composition_on_dense_weeks(spark):
    """lag 1 of lag j equals lag j+1 on the dense weekly series."""
    from pyspark.sql import Window

    from weekpanel.operators.features import lag_weekly
    from weekpanel.plans import queries as QQ

    from .conftest import SF_SMALL

    lags = lag_weekly(QQ._weekly(spark, SF_SMALL))
    w = Window.partitionBy("variable", "station").orderBy("year", "week")
    bad = 0
    for j in range(1, 4):
        shifted = F.lag(f"lag{j}", 1).over(w)
        bad += lags.select((~shifted.eqNullSafe(F.col(f"lag{j + 1}"))).alias("d")).filter("d").count()
    assert bad == 0
    assert lags.filter(F.col("lag4").isNotNull()).count() > 0
