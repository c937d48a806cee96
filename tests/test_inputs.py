"""Reading by column name, date options, reconciliation keys, whole reports, scratch folder."""

import os

import pytest
from pyspark.sql import functions as F

from weekpanel import cli, session
from weekpanel.functions.dates import NoValidDate
from weekpanel.operators.combine import combine_many
from weekpanel.operators.quality import reconcile_week
from weekpanel.plans.integrate import Inputs, combine_inputs
from weekpanel.session import scratch_path
from weekpanel.sources.readers import MissingColumn, scan_cases, scan_mapping


def _file(spark, name, text):
    path = os.path.join(scratch_path(spark, "t-in"), name)
    spark.createDataFrame([(x,) for x in text.strip().split("\n")], "v string").coalesce(1).write.text(path)
    return path


def test_cases_are_read_by_name(spark):
    path = _file(spark, "cases", "District,note, Year ,Cases,Week\nA,x,2020.0,3,2\nB,y,2021,4.5,3.0\nC,z,2020.5,NaN,nan\nNA,z,99999999999,1,1")
    rows = [tuple(r) for r in scan_cases(spark, path).collect()]
    assert rows == [(2020, 2, "A", 3.0), (2021, 3, "B", 4.5), (None, None, "C", None), (None, 1, None, 1.0)]
    with pytest.raises(MissingColumn, match="Week"):
        scan_cases(spark, _file(spark, "short", "Year,District,Cases\n2020,A,1"))


def test_mapping_is_read_by_name(spark):
    path = _file(spark, "mapping", "province,precipitation_station,temp_station,humidity_station,district_name,district_code\nP4,r,t,NA,Alpha,101")
    row = scan_mapping(spark, path).drop("src_row").first()
    assert row.asDict() == {"district_code": "101", "district_name": "Alpha", "temp_station": "t", "humidity_station": None, "precipitation_station": "r"}
    with pytest.raises(MissingColumn, match="temp_station"):
        scan_mapping(spark, _file(spark, "bad", "district_code,district_name\n1,A"))


def test_first_week_skips_missing_keys(spark):
    raw = spark.createDataFrame([(None, 2, "A", 3.0), (2020, None, "A", 9.0), (2020, 2, "A", 4.0)], "Year int, Week int, District string, Cases double")
    panel = spark.createDataFrame([(2020, 2, "A", 4.0)], "Year int, Week int, District string, Cases double")
    row = reconcile_week(raw, panel).first()
    assert (row.Year, row.Week, row.raw_cases, row.passed) == (2020, 2, 4.0, True)


def _sheet(spark, times):
    return spark.createDataFrame([(t, "1", i) for i, t in enumerate(times)], "time string, A string, src_row long")


def test_date_options(spark):
    mixed = _sheet(spark, ["1/2/2020 0:0:0", "2/2/2020", "3-2-2020"])
    days = lambda **k: sorted(str(r.date.date()) for r in combine_many({"humidity": [mixed]}, **k).cells.collect())
    assert days() == ["2020-02-01"]
    assert days(per_row=True) == ["2020-02-01", "2020-02-02"]
    assert days(per_row=True, infer=True) == ["2020-02-01", "2020-02-02", "2020-02-03"]
    iso = {"humidity": [_sheet(spark, ["2020-02-01", "x"])]}
    assert combine_many(iso).cells.count() == 0
    assert [str(r.date.date()) for r in combine_many(iso, infer=True).cells.collect()] == ["2020-02-01"]
    with pytest.raises(NoValidDate, match="humidity, part 1: none of 2 times"):
        combine_inputs(Inputs(None, iso, None, strict=True))
    assert combine_inputs(Inputs(None, iso, None, strict=True, infer=True)).cells.count() == 1


def test_unknown_sheets_are_refused(spark, capsys):
    with pytest.raises(ValueError, match="temp-max"):
        combine_inputs(Inputs(None, {"temp-max": []}, None))
    assert cli.main(["stations", "--mapping", "m", "--sheet", "temp-max=x.csv"], spark=spark) == 2
    assert "unknown sheet variable" in capsys.readouterr().err


def test_reports_are_whole_or_say_so(spark, capsys):
    wide = "period," + ",".join(f"D{i:03d}" for i in range(120)) + "\nW1 2020," + ",".join("1" for _ in range(120))
    path = _file(spark, "wide", wide)
    args = ["preprocess", "--wide", path, "--out", os.path.join(scratch_path(spark, "t-out"), "long")]
    assert cli.main(args, spark=spark) == 0
    assert capsys.readouterr().out.count("District=") == 120
    assert cli.main([*args[:-1], args[-1] + "2", "--rows", "5"], spark=spark) == 0
    out = capsys.readouterr().out
    assert out.count("District=") == 5 and "(5 of 120 rows)" in out


def test_stations_count_once_per_group(spark, capsys):
    hi = _file(spark, "hi", "time,S1,S2\n1/1/2020,1,2")
    lo = _file(spark, "lo", "time,S1,S2,S3\n1/1/2020,1,2,3")
    mapping = _file(spark, "m", "district_code,district_name,temp_station,humidity_station,precipitation_station\n1,A,S1,,\n2,B,S3,,")
    assert cli.main(["stations", "--mapping", mapping, "--sheet", f"temp_max={hi}", "--sheet", f"temp_min={lo}"], spark=spark) == 0
    out = capsys.readouterr().out
    assert "station_group=temp_station, count=2" in out and "ordinal=2, station=S2" in out
    assert "district_code=2, station=S3" in out


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_combine_sorts_rows_not_cells(spark):
    parts = {"humidity": [_sheet(spark, ["1/2/2020", "2/2/2020"]), _sheet(spark, ["2/2/2020", "3/2/2020"])]}
    plan = combine_many(parts).cells._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("min_by")  # the unpivot stands above the aggregate
    assert combine_many(parts).cells.groupBy("date").count().filter(F.col("count") > 1).isEmpty()


def test_no_year_gives_an_empty_panel(spark):
    from weekpanel.operators.panel import complete_panel, year_range

    cases = spark.createDataFrame([(None, 1, "A", 1.0)], "Year int, Week int, District string, Cases double")
    assert complete_panel(cases, *year_range(cases)).count() == 0
    assert complete_panel(cases, *year_range(cases.limit(0))).count() == 0


def _ragged(spark):
    return _file(spark, "ragged", 'Year,Week,District,Cases\n2020,1,A,3\n2020,2,B\n2020,3,C,4,x\n2020,4,"D, E",5\n2020,5,F,6,\n2020,5,F,6,,y\n2020')


def test_malformed_rows_are_reported(spark):
    from weekpanel.sources.readers import malformed_rows, scan_daily_wide

    path = _ragged(spark)
    got = sorted((r.kind, r.record) for r in malformed_rows(spark, path).collect())
    assert got == [("long", "2020,3,C,4,x"), ("long", "2020,5,F,6,"), ("long", "2020,5,F,6,,y"), ("short", "2020"), ("short", "2020,2,B")]
    assert malformed_rows(spark, path).count() == 5 and malformed_rows(spark, path).groupBy("kind").count().count() == 2
    cases = scan_cases(spark, path)
    assert sorted((r.Week or 0, r.District or "", r.Cases) for r in cases.collect()) == [(0, "", None), (1, "A", 3.0), (2, "B", None), (4, "D, E", 5.0)]
    assert cases.count() == 4 and cases.select("Week").count() == 4
    assert scan_daily_wide(spark, path).count() == 4
    with pytest.raises(Exception, match="has not 4 cells"):
        scan_cases(spark, path, malformed="fail").collect()
    with pytest.raises(ValueError, match="quarantine"):
        scan_cases(spark, path, malformed="drop")


def test_wide_cases_need_the_period(spark):
    from weekpanel.sources.readers import scan_cases_wide, scan_panel

    with pytest.raises(MissingColumn, match="period"):
        scan_cases_wide(spark, _file(spark, "noperiod", "week,A\nW1 2020,1"))
    path = os.path.join(scratch_path(spark, "t-in"), "panel")
    spark.createDataFrame([(2020, 1, "A", 1.0)], "Year int, Week int, District string, Cases double").write.parquet(path)
    with pytest.raises(MissingColumn, match="temp_lag0"):
        scan_panel(spark, path)
