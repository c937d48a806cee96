"""Sheets -> combined daily table -> weekly -> lags -> panel (FIXTURES B6, B7)."""

import datetime as dt

from pyspark.sql import functions as F

from weekpanel.operators.combine import combine_parts, mean_temperature, to_long
from weekpanel.operators.features import lag_weekly
from weekpanel.operators.panel import forward_fill, week_spine
from weekpanel.operators.rollup import weekly_rollup


def sheet(spark, rows, stations):
    cols = ["Time (NPT)"] + stations + ["src_row"]
    data = [(t, *[None if v is None else str(v) for v in vals], i) for i, (t, *vals) in enumerate(rows)]
    schema = ", ".join(f"`{c}` string" for c in cols[:-1]) + ", src_row long"
    return spark.createDataFrame(data, schema)


def part1(spark):
    return sheet(spark, [("30/12/2023", 10, 1), ("31/12/2023", 20, 2), ("3/1/2024", None, 3), ("7/1/2024", 30, None),
                         ("7/1/2024", 99, 7), ("22/1/2024", 50, 5)], ["a", "s"])


def part2(spark):
    return sheet(spark, [("31/12/2023", 7, 70), ("8/1/2024", None, 4), ("23/1/2024", 9, 6)], ["b ", "s"])


def test_combine_keep_first(spark):
    c = combine_parts(part1(spark), part2(spark))
    assert c.columns == ["date", "a", "s", "b"]
    got = {(str(r.date.date()), r.a, r.s, r.b) for r in c.collect()}
    assert got == {
        ("2023-12-30", 10.0, 1.0, None), ("2023-12-31", 20.0, 2.0, None), ("2024-01-03", None, 3.0, None),
        ("2024-01-07", 30.0, None, None), ("2024-01-08", None, 4.0, None), ("2024-01-22", 50.0, 5.0, None),
        ("2024-01-23", None, 6.0, 9.0),
    }


def weekly(spark, agg):
    c = combine_parts(part1(spark), part2(spark))
    w = weekly_rollup(to_long(c, "x"), agg)
    return {(r.year, r.week, r.station): r.value for r in w.collect()}


def test_weekly_mean_and_sum(spark):
    m = weekly(spark, "mean")
    assert (m[(2023, 52, "a")], m[(2023, 52, "s")], m[(2023, 52, "b")]) == (10, 1, None)
    assert (m[(2023, 53, "a")], m[(2023, 53, "s")], m[(2023, 53, "b")]) == (20, 2.5, None)
    assert (m[(2024, 1, "a")], m[(2024, 1, "s")]) == (30, 4)
    assert (m[(2024, 3, "a")], m[(2024, 3, "s")], m[(2024, 3, "b")]) == (50, 5.5, 9)
    assert len(m) == 4 * 3  # dense: every week of the table x every station
    s = weekly(spark, "sum")
    assert (s[(2023, 52, "b")], s[(2023, 53, "s")], s[(2024, 1, "b")], s[(2024, 3, "s")]) == (0, 5, 0, 11)


def test_lags_then_fill_on_spine(spark):
    c = combine_parts(part1(spark), part2(spark))
    w = weekly_rollup(to_long(c, "x"), "mean")
    lags = lag_weekly(w, [0, 1, 2]).filter(F.col("station") == "a").withColumn("District", F.lit("D"))
    districts = spark.createDataFrame([("D",)], "District string")
    spine = week_spine(districts, 2024, 2024, 5)
    joined = spine.join(
        lags.select("District", F.col("year").alias("Year"), F.col("week").alias("Week"), "lag0", "lag1", "lag2"),
        ["Year", "Week", "District"], "left",
    )
    filled = forward_fill(joined, ["lag0", "lag1", "lag2"])
    got = {r.Week: (r.lag0, r.lag1, r.lag2) for r in filled.collect()}
    assert got == {1: (30, 20, 10), 2: (30, 20, 10), 3: (50, 30, 20), 4: (50, 30, 20), 5: (50, 30, 20)}
    again = {r.Week: (r.lag0, r.lag1, r.lag2) for r in forward_fill(filled, ["lag0", "lag1", "lag2"]).collect()}
    assert again == got  # idempotent


def test_mean_temperature_position_vs_date(spark):
    d = [dt.datetime(2024, 1, i) for i in (1, 2, 3)]
    tmax = spark.createDataFrame([(d[0], 10.0), (d[1], 20.0), (d[2], 30.0)], "date timestamp_ntz, st double")
    tmin = spark.createDataFrame([(d[1], 2.0), (d[2], 4.0)], "date timestamp_ntz, st double")
    pos = {r.date: r.st for r in mean_temperature(tmax, tmin, "position").collect()}
    assert [pos[x] for x in d] == [6.0, 12.0, None]
    by_date = {r.date: r.st for r in mean_temperature(tmax, tmin, "date").collect()}
    assert [by_date[x] for x in d] == [None, 11.0, 17.0]


def test_mean_temperature_missing_min_column_falls_back(spark):
    d = dt.datetime(2024, 1, 1)
    tmax = spark.createDataFrame([(d, 10.0, 5.0)], "date timestamp_ntz, st double, only_max double")
    tmin = spark.createDataFrame([(d, 2.0)], "date timestamp_ntz, st double")
    r = mean_temperature(tmax, tmin).first()
    assert (r.st, r.only_max) == (6.0, 5.0)


def test_empty_part_flows_through(spark):
    bad = sheet(spark, [("not a date", 1, 2)], ["a", "s"])
    c = combine_parts(part1(spark), bad)
    assert c.count() == 5 and c.columns == ["date", "a", "s"]


def test_drop_invalid_dates_observed(spark):
    from pyspark.sql import Observation

    from weekpanel.operators.combine import drop_invalid_dates, parse_dates

    obs = Observation("dates")
    sh = sheet(spark, [("01/02/2020 00:00:00", 1), ("02/02/2020", 2), ("x", 3)], ["a"])
    kept = drop_invalid_dates(parse_dates(sh), obs)
    assert kept.count() == 1
    assert obs.get == {"rows": 3, "kept": 1}


def test_combine_typed_sheets(spark):
    """Sheets landed with a typed time column and numeric cells (e.g. from Parquet)."""
    rows = [(dt.datetime(2024, 1, 7), 1.5, 1e-5), (dt.datetime(2024, 1, 7), 9.0, 9.0), (dt.datetime(2024, 1, 8), float("nan"), 2.0)]
    p1 = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "`Time (NPT)` timestamp_ntz, a double, b double, src_row long")
    got = {str(r.date.date()): (r.a, r.b) for r in combine_parts(p1).collect()}
    assert got == {"2024-01-07": (1.5, 1e-5), "2024-01-08": (None, 2.0)}  # NaN -> missing
