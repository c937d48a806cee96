"""Readers and writers round trip; missing input is a clean error."""

import pytest

from weekpanel.session import scratch_path
from weekpanel.sources.readers import MissingInput, scan_cases, scan_daily_wide, scan_mapping
from weekpanel.sources.sinks import write_csv


def test_daily_sheet_roundtrip_keeps_headers_and_order(spark):
    cols = ["Time (NPT)", "Hetauda N.F.I. (mm)", "Jomsom TPB (°C) ", "Dhunibesi_delete"]
    rows = [(f"{d}/1/2024", str(d), None, " 1 ") for d in range(1, 21)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols)).repartition(3)
    path = scratch_path(spark, "t-sheet")
    write_csv(df.coalesce(1), path)
    back = scan_daily_wide(spark, path)
    assert back.columns[:4] == cols
    got = [r[0] for r in back.orderBy("src_row").collect()]
    assert got == [r[0] for r in df.coalesce(1).collect()]
    assert back.filter("`Dhunibesi_delete` = ' 1 '").count() == 20


def test_mapping_and_cases_roundtrip(spark):
    m = spark.createDataFrame([(" 101", "taplejung", "A (°C)", None, "A (mm)")],
                              "district_code string, district_name string, temp_station string, humidity_station string, precipitation_station string")
    p = scratch_path(spark, "t-map")
    write_csv(m, p)
    r = scan_mapping(spark, p).first()
    assert (r.district_code, r.humidity_station) == (" 101", None)
    c = spark.createDataFrame([(2020, 1, "101 X", None)], "Year int, Week int, District string, Cases double")
    p2 = scratch_path(spark, "t-cases")
    write_csv(c, p2)
    assert scan_cases(spark, p2).collect() == c.collect()


def test_missing_input(spark):
    with pytest.raises(MissingInput):
        scan_cases(spark, "/nonexistent/weekpanel/cases.csv")


def test_combine_csv_landed_sheets(spark):
    """Sheets read back from CSV carry a struct file-order key; keep-first still works."""
    from weekpanel.operators.combine import combine_parts

    p1 = spark.createDataFrame([("7/1/2024", "30", None), ("7/1/2024", "99", "7"), ("8/1/2024", "1", "2")],
                               "`Time (NPT)` string, `a (°C)` string, `s (°C)` string")
    p2 = spark.createDataFrame([("7/1/2024", "5", "6")], "`Time (NPT)` string, `s (°C)` string, `b (°C) ` string")
    paths = []
    for df in (p1, p2):
        path = scratch_path(spark, "t-landed")
        write_csv(df.coalesce(1), path)
        paths.append(path)
    c = combine_parts(scan_daily_wide(spark, paths[0]), scan_daily_wide(spark, paths[1]))
    got = {(str(r.date.date()), r["a (°C)"], r["s (°C)"], r["b (°C)"]) for r in c.collect()}
    assert got == {("2024-01-07", 30.0, None, None), ("2024-01-08", 1.0, 2.0, None)}


def test_scan_cases_missing_tokens(spark):
    """NaN and pandas' missing-value tokens arrive as NULL, so sums skip them."""
    import os

    path = scratch_path(spark, "t-na")
    local = path[len("file:"):] if path.startswith("file:") else path  # the checkpoint root may be a file: URI
    os.makedirs(local)
    with open(os.path.join(local, "cases.csv"), "w") as f:
        f.write("Year,Week,District,Cases\n2020,1,A,3\n2020,1,A,NaN\n2020,2,NA,NA\n2020,x,B,null\n2020,3,C,\n")
    rows = scan_cases(spark, path).collect()
    assert [tuple(r) for r in rows] == [(2020, 1, "A", 3.0), (2020, 1, "A", None), (2020, 2, None, None),
                                        (2020, None, "B", None), (2020, 3, "C", None)]


def test_parquet_landed_sheet(spark):
    import datetime as dt

    from weekpanel.operators.combine import combine_parts

    df = spark.createDataFrame([(dt.datetime(2024, 1, 7), 1.5), (dt.datetime(2024, 1, 7), 9.0), (dt.datetime(2024, 1, 8), None)],
                               "`Time (NPT)` timestamp_ntz, `a (mm)` double")
    path = scratch_path(spark, "t-pq")
    df.coalesce(1).write.parquet(path)
    got = {str(r.date.date()): r["a (mm)"] for r in combine_parts(scan_daily_wide(spark, path, fmt="parquet")).collect()}
    assert got == {"2024-01-07": 1.5, "2024-01-08": None}
