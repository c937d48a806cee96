"""The full build on a small hand-made input shaped like the original data (FIXTURES B6)."""

from weekpanel.plans.integrate import Inputs, build_panel

from .test_combine import part1, part2


def test_build_panel_end_to_end(spark):
    cases = spark.createDataFrame(
        [(2024, 1, "101 DELTA", 4.0), (2024, 2, "101 DELTA", None), (2024, 3, "DELTA", 1.0), (2024, 53, "101 DELTA", 9.0)],
        "Year int, Week int, District string, Cases double",
    )
    sheets = {v: [part1(spark), part2(spark)] for v in ("temp_max", "temp_min", "humidity", "precipitation")}
    mapping = spark.createDataFrame(
        [(" 101", "delta", "a", "s", "b", 0), ("102", "Ghost", "zz", None, "b", 1)],
        "district_code string, district_name string, temp_station string, humidity_station string, "
        "precipitation_station string, src_row long",
    )
    panel = build_panel(Inputs(cases_raw=cases, sheets=sheets, mapping=mapping))
    assert len(panel.columns) == 29
    rows = {r.Week: r for r in panel.filter("District = 'Delta'").collect()}
    assert len(rows) == 52 and panel.count() == 52  # one district, one year, weeks 1..52
    assert (rows[1].Cases, rows[2].Cases, rows[3].Cases) == (4.0, 0.0, 1.0)
    # mean temperature = max = min here; lags by weekly row position, then forward fill (B6)
    got = {w: (rows[w].temp_lag0, rows[w].temp_lag1, rows[w].temp_lag2) for w in range(1, 6)}
    assert got == {1: (30, 20, 10), 2: (30, 20, 10), 3: (50, 30, 20), 4: (50, 30, 20), 5: (50, 30, 20)}
    assert (rows[1].temp_max_lag0, rows[3].temp_min_lag1) == (30, 30)
    # humidity from station s (mean), precipitation from station b (sum: all-missing weeks -> 0)
    assert (rows[1].humidity_lag0, rows[1].humidity_lag1, rows[3].humidity_lag0) == (4.0, 2.5, 5.5)
    assert (rows[1].precipitation_lag0, rows[3].precipitation_lag0, rows[3].precipitation_lag3, rows[3].precipitation_lag4) == (0, 9, 0, None)
    assert rows[52].temp_lag0 == 50  # filled to the end
