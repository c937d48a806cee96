"""Column functions: calendar, names, period text, numbers, dates (FIXTURES B1-B5)."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from weekpanel.functions.calendar import calendar_trace, week_number, week_year
from weekpanel.functions.dates import parse_dates_column
from weekpanel.functions.numeric import coerce_double, rint2
from weekpanel.functions.text import (
    extract_period_week,
    extract_period_year,
    standardize_mapping_name,
    standardize_name,
    title_case,
)


B1 = [
    ("2019-01-01", 2018, 52), ("2019-01-05", 2018, 52), ("2019-01-06", 2019, 1), ("2022-12-31", 2022, 52),
    ("2023-01-01", 2023, 1), ("2023-12-30", 2023, 52), ("2023-12-31", 2023, 53), ("2024-01-06", 2023, 53),
    ("2024-01-07", 2024, 1), ("2024-12-31", 2024, 52), ("2025-01-04", 2024, 52), ("2025-01-05", 2025, 1),
]


def test_calendar_fixture(spark):
    df = spark.createDataFrame([(d,) for d, _, _ in B1], "d string").select(F.to_date("d").alias("d"))
    got = {(str(r.d), r.y, r.w) for r in df.select("d", week_year("d").alias("y"), week_number("d").alias("w")).collect()}
    assert got == {(d, y, w) for d, y, w in B1}


def test_calendar_properties_1999_2045(spark):
    """What defines the calendar: week 1 of a year begins on the year's first Sunday, every later Sunday begins
    the next week, and all other days belong to the week of the Sunday before them."""
    df = spark.range(0, (dt.date(2045, 12, 31) - dt.date(1999, 1, 1)).days + 1).select(
        F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).alias("d")
    )
    rows = df.select("d", week_year("d").alias("y"), week_number("d").alias("w")).orderBy("d").collect()
    assert len(rows) == 17167
    sundays = [r for r in rows if r.d.isoweekday() == 7]
    assert all((r.y, r.w) == (r.d.year, 1) for r in sundays if r.d.day <= 7 and r.d.month == 1)
    assert all(b.w == 1 if b.d.year > a.d.year else (b.y, b.w) == (a.y, a.w + 1) for a, b in zip(sundays, sundays[1:], strict=False))
    assert all((a.y, a.w) == (b.y, b.w) for a, b in zip(rows, rows[1:], strict=False) if b.d.isoweekday() != 7)
    years53 = sorted({r.y for r in rows if r.w == 53})
    assert years53 == [2000, 2006, 2012, 2017, 2023, 2028, 2034, 2040, 2045]


def test_calendar_trace(spark):
    df = spark.createDataFrame([("2019-01-03",), ("2019-01-06",)], "d string").select(F.to_date("d").alias("date"))
    rows = {str(r.date): r for r in calendar_trace(df).collect()}
    r = rows["2019-01-03"]
    assert (str(r.first_sunday), r.days_until_sunday, r.before_first_sunday, r.year, r.week) == ("2019-01-06", 5, True, 2018, 52)
    assert rows["2019-01-06"].days_since_first_sunday == 0


def test_period_text(spark):
    data = [("W40 2025Sun 2025", 2025, 40), ("W1 2020Tue 2020", 2020, 1), ("W5  20211", 2021, 5),
            ("x W7 2019 W8 2020", 2019, 7), ("no", None, None), (None, None, None)]
    df = spark.createDataFrame([(p,) for p, _, _ in data], "p string")
    got = [(r.y, r.w) for r in df.select(extract_period_year("p").alias("y"), extract_period_week("p").alias("w")).collect()]
    assert got == [(y, w) for _, y, w in data]


B3 = [("101 TAPLEJUNG", "Taplejung"), ("NAWALPARASI EAST", "Nawalparasi"), ("RUKUM (EAST)", "Rukum (East)"),
      (" 101 X", "101 X"), ("O'NEIL", "O'Neil"), ("301  chitawan ", "Chitwan"), ("EAST", "EAST"), ("12", "12"),
      ("12 ", ""), (None, None)]


def test_standardize_name_fixture(spark):
    df = spark.createDataFrame([(a,) for a, _ in B3], "n string")
    got = [r[0] for r in df.select(standardize_name("n")).collect()]
    assert got == [b for _, b in B3]


NAMES = [
    ("100 NATION_0", "Nation_0"), ("104  NATION_4 MIDDLE EAST", "Nation_4 Middle East"), ("kavrepalanchok", "Kavrepalanchowk"),
    ("  WEST", "WEST"), ("7 west", "WEST"), ("a-b c_d", "A-B C_D"), ("3x Y", "3X Y"), ("dhanusa ", "Dhanusha"), ("1 2 3", "2 3"),
    ("ÉCOLE du nord", "École Du Nord"), ("x.y(z)", "X.Y(Z)"), ("", ""), (" ", ""), ("NAWALPARASI WEST", "Nawalparasi"), (None, None),
]


def test_standardize_name_table(spark):
    df = spark.createDataFrame([(n,) for n, _ in NAMES], "n string")
    assert [r[0] for r in df.select(standardize_name("n")).collect()] == [e for _, e in NAMES]


def test_mapping_name_and_title(spark):
    df = spark.createDataFrame([("chitawan",), (" nation_3 middle east ",), ("west",)], "n string")
    got = [r[0] for r in df.select(standardize_mapping_name("n")).collect()]
    assert got == ["Chitwan", "Nation_3 Middle East", "West"]
    got = [r[0] for r in df.select(title_case("n")).collect()]
    assert got == ["Chitawan", " Nation_3 Middle East ", "West"]


def test_coerce_numeric(spark):
    good = [("12", 12.0), ("  3.5 ", 3.5), ("1e3", 1000.0), ("+5", 5.0), (".5", 0.5), ("5.", 5.0), ("\t7\n", 7.0)]
    bad = ["-", "Trace", "", "1d", "2f", "1,000", "1_000", "0x10", "True", None, "nan", "inf"]
    df = spark.createDataFrame([(a,) for a, _ in good] + [(b,) for b in bad], "t string")
    got = [r[0] for r in df.select(coerce_double("t")).collect()]
    assert got == [b for _, b in good] + [None] * len(bad)


def test_rint2_half_even(spark):
    df = spark.createDataFrame([(2.345,), (1.125,), (2.675,), (-1.005,), (1.5333,)], "x double")
    got = [r[0] for r in df.select(rint2("x")).collect()]
    # numpy's round (multiply, round half-even, divide) -- what a DataFrame round does
    assert got == np.round([2.345, 1.125, 2.675, -1.005, 1.5333], 2).tolist()


def test_parse_dates_table_level(spark):
    df = spark.createDataFrame([("01/02/2020",), ("1/2/2020",), ("31/12/2020",), ("12/31/2020",), ("29/02/2021",),
                                ("01/02/20",), ("2020-02-01",), (" 01/02/2020",)], "t string")
    got = [r[0] for r in df.select(parse_dates_column(df, "t")).collect()]
    assert [str(g.date()) if g else None for g in got] == ["2020-02-01", "2020-02-01", "2020-12-31"] + [None] * 5
    mixed = spark.createDataFrame([("01/02/2020 00:00:00",), ("02/02/2020",)], "t string")
    got = [r[0] for r in mixed.select(parse_dates_column(mixed, "t")).collect()]
    assert got[0] == dt.datetime(2020, 2, 1) and got[1] is None
    per_row = [r[0] for r in mixed.select(parse_dates_column(mixed, "t", per_row=True)).collect()]
    assert per_row == [dt.datetime(2020, 2, 1), dt.datetime(2020, 2, 2)]


def test_parse_dates_typed_passthrough(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 5, 10, 0),)], "t timestamp")
    assert df.select(parse_dates_column(df, "t")).first()[0] == dt.datetime(2020, 1, 5, 10, 0)


# --------------------------------------------------------------- properties
from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_ALPHABET = st.sampled_from(list("abcXYZ019 _-'()./\t") + ["É", "ü", "ß"])
_NAMES = st.lists(
    st.one_of(
        st.text(_ALPHABET, max_size=14),
        st.builds(lambda n, s: f"{n} {s}", st.integers(0, 999), st.text(_ALPHABET, max_size=10)),
        st.sampled_from(["chitawan", "NAWALPARASI WEST", " east ", "west", "12 ", " 7 x"]),
    ),
    min_size=1,
    max_size=40,
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_NAMES)
def test_standardize_name_properties(spark, names):
    """Outer blanks and letter case do not matter, a leading code is dropped, no result has outer blanks."""
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select(
        "n", standardize_name("n").alias("s"), standardize_name(F.concat(F.lit("  "), F.upper("n"), F.lit(" "))).alias("upper"),
        standardize_name(F.concat(F.lit("77 "), "n")).alias("coded"), standardize_name(F.concat(F.lit("Z "), "n")).alias("named"),
    ).collect()
    for r in rows:
        assert r.s == r.s.strip() and r.named.startswith("Z")
        if not r.n.strip()[:1].isdigit() and not r.n[:1].isspace():
            assert r.upper == r.s == r.coded


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from(list("aBc1 _-'(),.")), max_size=12), min_size=1, max_size=30))
def test_title_case_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(title_case("t")).collect()] == [t.title() for t in texts]


def test_title_case_multichar_upper(spark):
    texts = ["ßtraße", "ﬁeld (ﬂow)", "élan-vital"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(title_case("t")).collect()] == [t.title() for t in texts]
