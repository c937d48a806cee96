"""Non-default semantics offered next to the original behaviour."""

from pyspark.sql import functions as F

from weekpanel.operators import quality as Q
from weekpanel.operators.clean import standardize_names
from weekpanel.operators.combine import combine_parts, to_long
from weekpanel.operators.features import lag_weekly
from weekpanel.operators.panel import complete_panel, week_spine
from weekpanel.operators.rollup import merge_districts, weekly_rollup

from .test_combine import part1, part2
from .test_panel import raw_cases


def test_combine_coalesce_mode(spark):
    c = combine_parts(part1(spark), part2(spark), mode="coalesce")
    got = {str(r.date.date()): (r.a, r.s, r.b) for r in c.collect()}
    assert got["2023-12-31"] == (20.0, 2.0, 7.0)  # part 2's b fills in; first_row mode keeps it NULL
    assert got["2024-01-07"] == (30.0, 7.0, None)  # s from the duplicate row
    first = {str(r.date.date()): (r.a, r.s, r.b) for r in combine_parts(part1(spark), part2(spark)).collect()}
    assert first["2023-12-31"] == (20.0, 2.0, None)


def test_weekly_empty_sum_null(spark):
    long = to_long(combine_parts(part1(spark), part2(spark)), "x")
    zero = {(r.year, r.week, r.station): r.value for r in weekly_rollup(long, "sum").collect()}
    null = {(r.year, r.week, r.station): r.value for r in weekly_rollup(long, "sum", empty_sum="null").collect()}
    assert zero[(2023, 52, "b")] == 0.0 and null[(2023, 52, "b")] is None
    assert zero[(2024, 3, "s")] == null[(2024, 3, "s")] == 11.0


def test_lags_by_calendar_weeks(spark):
    w = weekly_rollup(to_long(combine_parts(part1(spark), part2(spark)), "x"), "mean").filter(F.col("station") == "a")
    rows = {(r.year, r.week): (r.lag1, r.lag2) for r in lag_weekly(w, [0, 1, 2]).collect()}
    cal = {(r.year, r.week): (r.lag1, r.lag2) for r in lag_weekly(w, [0, 1, 2], by="calendar").collect()}
    assert rows[(2024, 3)] == (30.0, 20.0)  # previous rows: 2024 w1, 2023 w53
    assert cal[(2024, 3)] == (None, 30.0)  # 2024 w2 has no row; w1 is two weeks back
    assert cal[(2024, 1)] == (20.0, 10.0)  # 2023 w53 and w52 are the calendar weeks before 2024 w1


def test_calendar_spine_and_reconcile_52(spark):
    d = spark.createDataFrame([("X",)], "District string")
    n = {r.Year: r.n for r in week_spine(d, 2022, 2024, "calendar").groupBy("Year").agg(F.max("Week").alias("n")).collect()}
    assert n == {2022: 52, 2023: 53, 2024: 52}
    raw53 = standardize_names(raw_cases(spark, [(2023, 53, "NAWALPARASI EAST", 5.0)]))
    panel = complete_panel(merge_districts(raw53), 2020, 2023)
    strict = {r.District: r.passed for r in Q.reconcile_totals(raw53, panel).collect()}
    weeks52 = {r.District: r.passed for r in Q.reconcile_totals(raw53, panel, max_week=52).collect()}
    assert strict["Nawalparasi"] is False and weeks52["Nawalparasi"] is True
    cal_panel = complete_panel(merge_districts(raw53), 2020, 2023, weeks="calendar")
    assert {r.District: r.passed for r in Q.reconcile_totals(raw53, cal_panel).collect()}["Nawalparasi"] is True


def test_was_reported_flag(spark):
    raw = standardize_names(raw_cases(spark))
    panel = complete_panel(merge_districts(raw), 2020, 2020, flag_reported=True)
    got = {(r.District, r.Week): (r.Cases, r.was_reported) for r in panel.filter("Week <= 2").collect()}
    assert got[("Nawalparasi", 1)] == (7.0, True)
    assert got[("Kathmandu", 2)] == (0.0, True)  # reported, all missing -> 0 but flagged
    assert got[("Kathmandu", 1)] == (0.0, False)  # never reported
