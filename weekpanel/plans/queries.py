"""Registry of every query: a Spark builder ``(spark, sf_dir) -> DataFrame``
and the DuckDB SQL that states the same result independently.

Each builder reads the test tables of ``sf_dir`` through the stand-ins of
:mod:`weekpanel.plans.standin` and applies one operator (or the full build).
Dates are returned as ``yyyy-MM-dd`` text so both engines hash them alike.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.functions.calendar import calendar_trace, week_number, week_year
from weekpanel.functions.numeric import coerce_double
from weekpanel.functions.text import standardize_name
from weekpanel.operators import quality as Q
from weekpanel.operators.clean import fill_all, keep_first, trim_columns
from weekpanel.operators.combine import dated_rows, first_rows, list_sheets, mean_temperature, to_long
from weekpanel.operators.features import lag_features, mapping_long, missing_stations, prepare_mapping
from weekpanel.operators.panel import complete_panel, features_wide, integrate_panel, week_spine, year_range
from weekpanel.operators.reshape import melt_cases, pivot_district_year, pivot_year_district
from weekpanel.operators.rollup import cases_by_district, national_by_week, national_by_year, weekly_rollup
from weekpanel.operators.util import qcol
from weekpanel.plans import integrate as I
from weekpanel.plans import run
from weekpanel.plans import sqlparts as S
from weekpanel.plans import standin
from weekpanel.schemas import PANEL_KEYS, STATION_GROUP, VARIABLES, feature_columns
from weekpanel.session import scratch_path
from weekpanel.sources.sinks import CSV_WRITE

Builder = Callable[[SparkSession, str], DataFrame]

# ----------------------------------------------------------------- memo
# Stand-in inputs are kept by the executors once per (session, scale); queries of
# one session share them.  ``clear_cache`` makes the next query rebuild them
# (the bench does this so every timing is end to end).
_MEMO: dict = {}


def clear_cache() -> None:
    _MEMO.clear()
    active = SparkSession.getActiveSession()
    if active is not None:
        active.catalog.clearCache()


def _memo(spark: SparkSession, sf: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def _nations(spark, sf):
    return _memo(spark, sf, "nations", lambda: standin.nation_dimension(spark, sf))


def _weather(spark, sf) -> I.Inputs:
    """Sheets and mapping only: queries on the weather side never build the case tables."""
    return _memo(spark, sf, "weather", lambda: standin.inputs(spark, sf, cases=False, nations=_nations(spark, sf)))


def _wide(spark, sf):
    return _memo(spark, sf, "cases_wide", lambda: standin.cases_wide(spark, sf, _nations(spark, sf)))


def _inputs(spark, sf) -> I.Inputs:
    def make():
        from dataclasses import replace

        from weekpanel.operators.reshape import cases_long_from_wide

        return replace(_weather(spark, sf), cases_raw=cases_long_from_wide(_wide(spark, sf)))

    return _memo(spark, sf, "inputs", make)


def _comb(spark, sf):
    return _memo(spark, sf, "comb", lambda: I.combine_inputs(_weather(spark, sf), hold="cache"))


def _obs(spark, sf):
    return _memo(spark, sf, "obs", lambda: I.observations(_weather(spark, sf), combined=_comb(spark, sf)))


def _weekly(spark, sf):
    return weekly_rollup(_obs(spark, sf))


def _features(spark, sf):
    inp = _weather(spark, sf)
    return lag_features(_weekly(spark, sf), prepare_mapping(inp.mapping, inp.aliases))


def _base(spark, sf):
    return _memo(spark, sf, "base", lambda: I.base_panel(_inputs(spark, sf)))


def _panel(spark, sf):
    return integrate_panel(_base(spark, sf), _features(spark, sf))


def _joined(spark, sf):
    """Panel after the feature join, before the forward fill."""
    wide = features_wide(_features(spark, sf))
    return _base(spark, sf).join(wide, PANEL_KEYS, "left")


def _raw_filled(spark, sf):
    return fill_all(_inputs(spark, sf).cases_raw)


def _raw_std(spark, sf):
    inp = _inputs(spark, sf)
    return inp.cases_raw.withColumn("District", standardize_name("District", inp.aliases))


def _day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def _ts(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _sheets(spark, sf):
    for v, parts in _weather(spark, sf).sheets.items():
        for i, sh in enumerate(parts, 1):
            yield v, i, sh


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def _roundtrip_csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").options(**CSV_WRITE).csv(path)
    return path


# ----------------------------------------------------------------- builders
def q_week_calendar(spark, sf):
    d = standin.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select(_day("d").alias("date"), week_year("d").alias("year"), week_number("d").alias("week"))


def q_calendar_trace(spark, sf):
    days = standin.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    first = days.orderBy("date").limit(14)
    t = calendar_trace(first)
    return t.select(*[_day(c).alias(c) if c in ("date", "jan_1", "first_sunday") else c for c in t.columns])


def q_extract_period(spark, sf):
    from weekpanel.operators.clean import extract_period

    return extract_period(_wide(spark, sf).select("period"), "period")


def q_melt_cases(spark, sf):
    return melt_cases(_wide(spark, sf))


def q_scan_cases_wide(spark, sf):
    from weekpanel.sources.readers import scan_cases_wide

    path = _roundtrip_csv(_wide(spark, sf), "cases-wide")
    return melt_cases(scan_cases_wide(spark, path))


def q_scan_cases(spark, sf):
    from weekpanel.sources.readers import scan_cases

    # columns in another order, one more column, and years written as decimals (2020.0)
    landed = _inputs(spark, sf).cases_raw.select(
        "District", "Cases", F.lit("x").alias("note"), F.col("Year").cast("double").alias("Year"), "Week"
    )
    return scan_cases(spark, _roundtrip_csv(landed, "cases-long"))


def q_scan_malformed(spark, sf):
    """A landed case file with short rows (week 7) and long rows (week 9): the rows read, and those reported."""
    from weekpanel.sources.readers import malformed_rows, scan_cases

    cases = _inputs(spark, sf).cases_raw
    cells = F.concat_ws(",", F.col("Year").cast("string"), F.col("Week").cast("string"), "District")
    case = F.concat(F.lit(","), F.coalesce(F.col("Cases").cast("string"), F.lit("")))
    line = F.when(F.col("Week") == 7, cells).when(F.col("Week") == 9, F.concat(cells, case, F.lit(",late"))).otherwise(F.concat(cells, case))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # each file starts with the header
    path = scratch_path(spark, "ragged")
    cases.select(F.when(first, F.concat(F.lit("Year,Week,District,Cases\n"), line)).otherwise(line).alias("value")).write.text(path)
    read = scan_cases(spark, path)
    shown = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in read.columns])
    return read.select(F.lit("read").alias("kind"), shown.alias("record")).unionByName(malformed_rows(spark, path).select("kind", "record"))


def q_sink_cases_long(spark, sf):
    from weekpanel.sources.readers import scan_cases
    from weekpanel.sources.sinks import write_cases_long

    path = scratch_path(spark, "sink-cases")
    write_cases_long(_inputs(spark, sf).cases_raw, path)
    return scan_cases(spark, path)


def q_standardize_names(spark, sf):
    inp = _inputs(spark, sf)
    raw = inp.cases_raw.select(F.col("District").alias("raw_name")).distinct()
    return raw.select("raw_name", standardize_name("raw_name", inp.aliases).alias("District"))


def q_merge_districts(spark, sf):
    return I.clean_cases(_inputs(spark, sf))


def q_week_spine(spark, sf):
    inp = _inputs(spark, sf)
    return week_spine(I.clean_cases(inp).select("District").distinct(), *year_range(inp.cases_raw))


def q_complete_panel(spark, sf):
    inp = _inputs(spark, sf)
    return complete_panel(I.clean_cases(inp), *year_range(inp.cases_raw))


def _dated(spark, sf):
    """All sheet rows with the date that the build reads for them."""
    return dated_rows(list_sheets(_weather(spark, sf).sheets))


def _dated_every_day(spark, sf):
    """As ``_dated``, with the days that the build's temp_min sheets lack."""
    whole = _memo(spark, sf, "every-day", lambda: standin.inputs(spark, sf, cases=False, nations=_nations(spark, sf), every_day=True))
    return dated_rows(list_sheets(whole.sheets))


def q_parse_dates(spark, sf):
    return _dated_every_day(spark, sf).select("variable", "part", "src_row", "time_text", _ts("date").alias("date"))


def q_drop_invalid_dates(spark, sf):
    return _dated(spark, sf).groupBy("variable", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.count("date").alias("kept"), F.count_if(F.col("date").isNull()).alias("dropped")
    )


def q_coerce_numeric(spark, sf):
    out = []
    for v, p, sh in _sheets(spark, sf):
        t = trim_columns(sh)
        stations = [c for c in t.columns[1:] if c != "src_row"]
        long = t.unpivot(["src_row"], [qcol(s) for s in stations], "station", "text")
        out.append(long.select(F.lit(v).alias("variable"), F.lit(p).alias("part"), "src_row", "station", "text",
                               coerce_double("text").alias("value")))
    return _union(out)


def q_date_counts(spark, sf):
    """Rows, kept and dropped dates of every sheet, observed while the combine writes its result."""
    combined = I.combine_inputs(_weather(spark, sf), hold="write")
    return spark.createDataFrame(combined.counts(), "variable string, part int, rows long, kept long, dropped long")


def q_union_parts(spark, sf):
    return _dated(spark, sf).filter("date IS NOT NULL").select("variable", "part", "src_row", _ts("date").alias("date"))


def q_dedup_dates(spark, sf):
    return first_rows(_dated_every_day(spark, sf)).select("variable", _ts("date").alias("date"), "part", "src_row")


def q_combine_parts(spark, sf):
    long = _comb(spark, sf).long()
    return long.select("variable", _ts("date").alias("date"), "station", "value")


def q_empty_part(spark, sf):
    """A part with no parsable date (its format is not in the list) contributes
    no rows but keeps its columns: the other part's rows get NULL cells there."""
    from weekpanel.operators.combine import combine_many

    c = combine_many(_weather(spark, sf).sheets, formats=["d/M/yyyy H:m:s"])
    return c.long().select("variable", _ts("date").alias("date"), "station", "value")


def q_mean_temperature(spark, sf):
    return I.mean_of(_comb(spark, sf)).cells.select(_ts("date").alias("date"), "station", "value")


def q_mean_temperature_date(spark, sf):
    return I.mean_of(_comb(spark, sf), align="date").cells.select(_ts("date").alias("date"), "station", "value")


def q_mean_temperature_zip(spark, sf):
    """The wide form: a zip of the two combined wide tables by row position."""
    c = _comb(spark, sf)
    m = mean_temperature(c.wide("temp_max"), c.wide("temp_min"), align="position")
    return to_long(m, "temp").select(_ts("date").alias("date"), "station", "value")


def q_weekly_mean(spark, sf):
    return _weekly(spark, sf).filter(F.col("variable") != "precipitation")


def q_weekly_sum(spark, sf):
    return _weekly(spark, sf).filter(F.col("variable") == "precipitation")


def q_lag_features(spark, sf):
    return _features(spark, sf)


def q_features_wide(spark, sf):
    return features_wide(_features(spark, sf))


def q_integrate_panel(spark, sf):
    return _panel(spark, sf)


def flagship(spark, sf) -> str:
    """The flagship job: all stages written and published (panel, weekly values, summary, completeness); their folder."""
    out = scratch_path(spark, "entry")
    run.PanelRun(spark, _inputs(spark, sf), out).run()
    return out


def q_entry(spark, sf):
    """The flagship job; returns the run's report, read from what was published."""
    return run.report(spark, _inputs(spark, sf), flagship(spark, sf))


APPENDED_YEAR = 2001


def q_append_year(spark, sf):
    """The years before, built and published; then the last year added to them."""
    out, nations = scratch_path(spark, "append-year"), _nations(spark, sf)
    before, after = (standin.inputs(spark, sf, nations=nations, years=y) for y in ((0, APPENDED_YEAR - 1), (APPENDED_YEAR, APPENDED_YEAR)))
    run.PanelRun(spark, before, out, run.Options(align="date")).run()
    run.append_year(spark, after, out, APPENDED_YEAR)
    return run.read_output(spark, out, "panel")


def q_forward_fill(spark, sf):
    """The forward fill alone, applied to the joined (unfilled) panel."""
    from weekpanel.operators.panel import forward_fill

    return forward_fill(_joined(spark, sf), feature_columns())


def q_ordered_panel(spark, sf):
    """The panel in output order (District, Year, Week): a distributed range sort."""
    return I.ordered(_panel(spark, sf))


def q_station_long(spark, sf):
    """Station series stacked as one block of rows per district (weekly values before lags)."""
    from weekpanel.operators.features import mapping_long, variable_groups
    from weekpanel.functions.text import strip_ws, title_case

    inp = _weather(spark, sf)
    ml = mapping_long(prepare_mapping(inp.mapping, inp.aliases)).filter(F.col("station").isNotNull())
    ml = ml.select(title_case(strip_ws("district_name")).alias("district_name"), "station_group", "station")
    w = _weekly(spark, sf).withColumn("station_group", F.element_at(variable_groups(), F.col("variable")))
    return w.join(ml, ["station_group", "station"]).select("variable", "district_name", "year", "week", "value")


def q_sink_panel(spark, sf):
    from weekpanel.sources.readers import scan_panel
    from weekpanel.sources.sinks import write_panel

    path = scratch_path(spark, "panel")
    write_panel(_panel(spark, sf), path)
    return scan_panel(spark, path)


def q_scan_panel(spark, sf):
    from weekpanel.sources.readers import scan_panel
    from weekpanel.sources.sinks import write_panel

    path = scratch_path(spark, "panel-csv")
    write_panel(_panel(spark, sf), path, fmt="csv")
    return scan_panel(spark, path, fmt="csv")


def q_district_summary(spark, sf):
    return Q.district_summary(_panel(spark, sf))


def q_sink_summary(spark, sf):
    from weekpanel.sources.sinks import write_summary

    summary = Q.district_summary(_panel(spark, sf))
    path = scratch_path(spark, "summary")
    write_summary(summary, path)
    return spark.read.schema(summary.schema).option("header", True).csv(path)


def q_completeness(spark, sf):
    return Q.completeness(_panel(spark, sf))


def q_null_counts(spark, sf):
    return Q.null_counts(_inputs(spark, sf).cases_raw)


def q_join_coverage(spark, sf):
    return Q.join_coverage(_joined(spark, sf), VARIABLES)


def q_cell_completeness(spark, sf):
    return Q.cell_completeness(_panel(spark, sf), feature_columns())


def q_zero_weeks(spark, sf):
    return Q.zero_weeks(_base(spark, sf))


def q_describe(spark, sf):
    return Q.describe(_inputs(spark, sf).cases_raw)


def q_table_info(spark, sf):
    return Q.table_info(_inputs(spark, sf).cases_raw)


def q_distinct_districts(spark, sf):
    """Distinct cleaned districts in the merged cases and in the panel, one row each."""
    cases = I.clean_cases(_inputs(spark, sf)).agg(F.count_distinct("District").alias("districts"))
    panel = _base(spark, sf).agg(F.count_distinct("District").alias("districts"))
    return cases.select(F.lit("cases").alias("source"), "districts").unionByName(
        panel.select(F.lit("panel").alias("source"), "districts"))


def q_panel_extent(spark, sf):
    return Q.panel_extent(_panel(spark, sf))


def q_national_by_year(spark, sf):
    return national_by_year(_raw_filled(spark, sf))


def q_national_by_week(spark, sf):
    return national_by_week(_raw_filled(spark, sf))


def q_cases_by_district(spark, sf):
    return cases_by_district(_raw_filled(spark, sf))


def q_filtered_total(spark, sf):
    from weekpanel.operators.rollup import filtered_total

    return filtered_total(_raw_filled(spark, sf), F.coalesce(F.col("District").contains("NATION_2"), F.lit(False)))


def q_filter_contains(spark, sf):
    from weekpanel.operators.clean import filter_contains

    return filter_contains(_inputs(spark, sf).cases_raw, "District", "NATION_1")


def q_filter_equals(spark, sf):
    from weekpanel.operators.clean import filter_equals

    return filter_equals(_panel(spark, sf), "District", "Nation_1")


def q_filter_week(spark, sf):
    from weekpanel.operators.clean import filter_week

    return filter_week(_panel(spark, sf), "Nation_2", 1997, 10)


def q_fill_cases(spark, sf):
    """Missing cases -> 0 on the raw long table (names and keys untouched)."""
    from weekpanel.operators.clean import fill_cases

    return fill_cases(_inputs(spark, sf).cases_raw)


def q_first_week(spark, sf):
    """The first (Year, Week) group, in key order, of the raw rows whose name contains a text."""
    from weekpanel.operators.clean import filter_contains

    sel = filter_contains(_raw_filled(spark, sf), "District", "NATION_2")
    return sel.groupBy("Year", "Week").agg(F.sum("Cases").alias("Cases")).orderBy("Year", "Week").limit(1)


def q_fill_all(spark, sf):
    return _raw_filled(spark, sf)


# Pivot columns are arguments: the raw names of the stand-in's districts, and its
# years; a value outside the list is an error.
PIVOT_DISTRICTS = [f"{100 + k} " + (f" NATION_{k} MIDDLE EAST" if k % 5 == 4 else f"NATION_{k}") for k in range(25)]
PIVOT_YEARS = list(range(1995, 2002))


def q_pivot_year_district(spark, sf):
    return pivot_year_district(_raw_filled(spark, sf), [n.raw for n in _nations(spark, sf)])


def q_pivot_district_year(spark, sf):
    return pivot_district_year(_raw_filled(spark, sf), PIVOT_YEARS)


def q_top_districts(spark, sf):
    return Q.top_n(cases_by_district(_raw_filled(spark, sf)), 20, "Cases", "District")


def q_sample_rows(spark, sf):
    return _panel(spark, sf).orderBy("District", "Year", "Week").limit(5)


def q_reconcile_totals(spark, sf):
    return Q.reconcile_totals(_raw_std(spark, sf), _panel(spark, sf))


def q_reconcile_week(spark, sf):
    return Q.reconcile_week(_raw_std(spark, sf), _panel(spark, sf))


DRILL_DISTRICT = "NATION_1"


def q_week_drilldown(spark, sf):
    """Weeks 1-2 of the first year of the mean-temperature series of one district's station."""
    from weekpanel.functions.text import strip_ws

    m = _weather(spark, sf).mapping
    station = m.filter(F.upper(strip_ws("district_name")) == DRILL_DISTRICT).orderBy("src_row").select("temp_station").limit(1)
    temp = _obs(spark, sf).filter(F.col("variable") == "temp")
    series = temp.join(F.broadcast(station), F.col("station") == F.col("temp_station"), "left_semi")
    return Q.week_drilldown(series.select("date", "value"), 2)


def q_map_stations(spark, sf):
    inp = _weather(spark, sf)
    ml = mapping_long(prepare_mapping(inp.mapping, inp.aliases))
    groups = spark.createDataFrame(list(STATION_GROUP.items()), "variable string, station_group string")
    have = _obs(spark, sf).select("variable", "station").distinct()
    j = F.broadcast(groups).join(ml, "station_group").join(have, ["variable", "station"], "left_semi")
    return j.select("variable", "district_name", "station")


def _part1_catalog(spark, sf):
    """The diagnostic's view: part 1, headers as landed, one variable per station group."""
    return Q.group_catalog(Q.station_catalog(spark, _weather(spark, sf).sheets, parts=[1], trim=False))


def q_missing_stations(spark, sf):
    m = _weather(spark, sf).mapping
    return missing_stations(m, _part1_catalog(spark, sf)).select("station_group", "district_code", "station")


def q_missing_stations_top(spark, sf):
    m = _weather(spark, sf).mapping
    cat = _part1_catalog(spark, sf)
    ml = m.unpivot(["district_code", "src_row"], ["humidity_station", "precipitation_station", "temp_station"], "station_group", "station")
    miss = ml.join(F.broadcast(cat.distinct()), ["station_group", "station"], "left_anti")
    top = Q.first_n_per_group(miss, "station_group", ["src_row"], 10)
    return top.select("station_group", "position", "district_code", "station", "total", "more")


def q_dedup_mapping(spark, sf):
    inp = _weather(spark, sf)
    return prepare_mapping(inp.mapping, inp.aliases)


def q_standardize_mapping(spark, sf):
    from weekpanel.operators.clean import normalize_codes, standardize_mapping

    inp = _weather(spark, sf)
    return normalize_codes(standardize_mapping(inp.mapping, inp.aliases))


def q_normalize_codes(spark, sf):
    from weekpanel.operators.clean import normalize_codes

    return normalize_codes(_weather(spark, sf).mapping).select("src_row", "district_code")


def q_table_shape(spark, sf):
    inp = _inputs(spark, sf)
    tabs = [("cases", inp.cases_raw), ("mapping", inp.mapping)] + [
        (f"{v}_part{p}", sh.drop("src_row")) for v, p, sh in _sheets(spark, sf)
    ]
    return _union([t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(len(t.columns)).alias("columns")) for n, t in tabs])


def q_station_catalog(spark, sf):
    sheets = _weather(spark, sf).sheets
    counts = _union([
        Q.table_info(sh.drop("src_row")).select(F.lit(v).alias("variable"), F.lit(p).alias("part"), F.col("column").alias("station"), "non_null")
        for v, p, sh in _sheets(spark, sf)])
    catalog = Q.station_catalog(spark, sheets, trim=False)
    return catalog.join(counts, ["variable", "part", "station"]).select("variable", "part", "ordinal", "station", "non_null")


def q_trim_columns(spark, sf):
    """Every sheet header before and after trimming, with its non-missing cell count."""
    out = []
    for v, p, sh in _sheets(spark, sf):
        raw = sh.drop("src_row")
        trimmed = F.create_map(*[x for c in raw.columns for x in (F.lit(c), F.lit(c.strip()))])
        info = Q.table_info(raw)
        out.append(info.select(F.lit(v).alias("variable"), F.lit(p).alias("part"), "ordinal",
                               F.col("column").alias("header"), F.element_at(trimmed, F.col("column")).alias("trimmed"),
                               "non_null"))
    return _union(out)


def q_column_dictionary(spark, sf):
    """Columns of every landed table (sheets and mapping): ordinal, name, type, non-missing count."""
    inp = _weather(spark, sf)
    tabs = [(f"{v}_part{p}", sh) for v, p, sh in _sheets(spark, sf)] + [("mapping", inp.mapping)]
    return _union([Q.table_info(t.drop("src_row")).select(F.lit(n).alias("table"), "ordinal", "column", "type", "non_null")
                   for n, t in tabs])


def q_date_positions(spark, sf):
    """Position of each kept date of the max and min tables, in date order (the zip key)."""
    from weekpanel.operators.util import with_row_position

    dates = _comb(spark, sf).long(["temp_max", "temp_min"]).select("variable", "date").distinct()
    pos = with_row_position(dates, "date", "pos", partition=["variable"])
    return pos.select("variable", _ts("date").alias("date"), "pos")


def q_scan_mapping(spark, sf):
    from weekpanel.sources.readers import scan_mapping

    m = _weather(spark, sf).mapping.drop("src_row")
    landed = m.select(F.lit("p").alias("province"), *reversed(m.columns))  # another order, one more column
    return scan_mapping(spark, _roundtrip_csv(landed, "mapping")).drop("src_row")


def q_scan_daily_wide(spark, sf):
    from weekpanel.sources.readers import scan_daily_wide

    out = []
    for v, part, sh in _sheets(spark, sf):
        back = scan_daily_wide(spark, _roundtrip_csv(sh.drop("src_row"), "sheet"))
        stations = [c for c in back.columns[1:] if c != "src_row"]
        long = back.unpivot([back.columns[0]], [qcol(s) for s in stations], "station", "text")
        out.append(long.select(F.lit(v).alias("variable"), F.lit(part).alias("part"), F.col(back.columns[0]).alias("time_text"), F.trim("station").alias("station"), "text"))
    return _union(out)


def q_streaming_weekly(spark, sf):
    from weekpanel.streaming.weekly import weekly_rollup_stream

    return weekly_rollup_stream(spark, _obs(spark, sf))


# ----------------------------------------------------------------- oracle SQL
_ALL = S.with_ctes(*S.ALL)
_CASES = S.with_ctes(S.NATIONS, S.CASES)
_SHEETS = S.with_ctes(S.NATIONS, S.WEATHER)
_EVERY_DAY = S.with_ctes(S.NATIONS, S.EVERY_DAY)
_MAP = S.with_ctes(S.NATIONS, S.MAPPING)
_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_FC = S.FEATURE_COLS
_PANEL_COLS = ["Year", "Week", "Cases"] + _FC


def _summary_sql() -> str:
    aggs = []
    for c in _PANEL_COLS:
        aggs += [
            f"count({c}) AS {c}_count",
            f"round_even(CAST(sum(CAST({c} AS DECIMAL(28, 9))) AS DOUBLE) / nullif(count({c}), 0) * 100, 0) / 100 AS {c}_mean",
            f"round_even(stddev_samp({c}) * 100, 0) / 100 AS {c}_std",
            f"round_even(min({c}) * 100, 0) / 100 AS {c}_min",
            f"round_even(max({c}) * 100, 0) / 100 AS {c}_max",
        ]
    return _ALL + "SELECT District, " + ", ".join(aggs) + " FROM panel GROUP BY District"


def _completeness_sql() -> str:
    cols = ["Year", "Week", "District", "Cases"] + _FC
    parts = " UNION ALL ".join(
        f"SELECT {i + 1} AS ordinal, '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS missing, count(*) AS total FROM panel"
        for i, c in enumerate(cols)
    )
    return _ALL + f"SELECT ordinal, \"column\", missing, missing * 100.0 / total AS missing_pct FROM ({parts}) WHERE missing > 0"


def _entry_sql() -> str:
    cols = ["Year", "Week", "District", "Cases"] + _FC
    missing = " UNION ALL ".join(
        f"SELECT '{c}' AS item, count(*) AS total, CAST(count_if({c} IS NULL) AS BIGINT) AS n FROM panel" for c in cols)
    return _ALL.rstrip() + f""",
report AS (
  SELECT 'dropped dates' AS section, variable || ' part ' || part AS item, count(*) AS total, count(*) - count(date) AS n
  FROM parsed GROUP BY variable, part
  UNION ALL SELECT 'missing values', item, total, n FROM ({missing}) WHERE n > 0
  UNION ALL
  SELECT 'districts without station', vg.variable, count(*), CAST(count_if(NOT EXISTS (
           SELECT 1 FROM var_stations s WHERE s.station = m.station
             AND s.variable = CASE vg.variable WHEN 'temp' THEN 'temp_max' ELSE vg.variable END)) AS BIGINT)
  FROM vg JOIN map_long m ON m.station_group = vg.station_group GROUP BY vg.variable
  UNION ALL SELECT 'rows with cases', 'panel', count(*), CAST(count_if(Cases > 0) AS BIGINT) FROM panel
  UNION ALL SELECT 'rows with cases', 'summary', count(*), CAST(count_if(most > 0) AS BIGINT)
  FROM (SELECT District, max(Cases) AS most FROM panel GROUP BY District))
SELECT section, item, total, n, n * 100.0 / total AS pct FROM report"""


def _null_counts_sql() -> str:
    cols = ["Year", "Week", "District", "Cases"]
    parts = " UNION ALL ".join(
        f"SELECT {i + 1} AS ordinal, '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS missing, count(*) AS total FROM cases_raw"
        for i, c in enumerate(cols)
    )
    return _CASES + parts


def _coverage_sql() -> str:
    joined = S.with_ctes(*S.ALL[:-1], S.PANEL.split("panel AS")[0].rstrip().rstrip(","))
    parts = " UNION ALL ".join(f"SELECT '{v}' AS variable, count({v}_lag0) AS filled, count(*) AS total FROM joined" for v in VARIABLES)
    return joined + f"SELECT variable, filled, total, filled * 100.0 / total AS pct FROM ({parts})"


def _cell_sql() -> str:
    filled = " + ".join(f"count({c})" for c in _FC)
    return _ALL + f"SELECT filled, total, filled * 100.0 / total AS pct FROM (SELECT {filled} AS filled, count(*) * {len(_FC)} AS total FROM panel)"


def _describe_sql() -> str:
    stats = [
        ("count", "CAST(count({c}) AS DOUBLE)"),
        ("mean", "avg({c})"),
        ("std", "stddev_samp({c})"),
        ("min", "CAST(min({c}) AS DOUBLE)"),
        ("25%", "quantile_cont({c}, 0.25)"),
        ("50%", "quantile_cont({c}, 0.5)"),
        ("75%", "quantile_cont({c}, 0.75)"),
        ("max", "CAST(max({c}) AS DOUBLE)"),
    ]
    parts = " UNION ALL ".join(
        f"SELECT '{s}' AS statistic, " + ", ".join(f.format(c=c) + f" AS {c}" for c in ("Year", "Week", "Cases")) + " FROM cases_raw"
        for s, f in stats
    )
    return _CASES + parts


_TEMP_STATIONS_AS_TEMP = "SELECT 'temp' AS variable, station FROM var_stations WHERE variable = 'temp_max' UNION ALL SELECT variable, station FROM var_stations"

_CAT1 = """
cat1 AS (
  SELECT CASE s.variable WHEN 'humidity' THEN 'humidity_station' WHEN 'precipitation' THEN 'precipitation_station'
         ELSE 'temp_station' END AS station_group, s.station
  FROM stations s WHERE s.part = 1 AND s.variable <> 'temp_min'),
raw_long AS (
  SELECT district_code, src_row, 'humidity_station' AS station_group, humidity_station AS station FROM map_raw
  UNION ALL SELECT district_code, src_row, 'precipitation_station', precipitation_station FROM map_raw
  UNION ALL SELECT district_code, src_row, 'temp_station', temp_station FROM map_raw),
miss AS (
  SELECT r.* FROM raw_long r
  WHERE NOT EXISTS (SELECT 1 FROM cat1 c WHERE c.station_group = r.station_group AND c.station = r.station))"""
_MISS = S.with_ctes(S.NATIONS, S.WEATHER, S.MAPPING, _CAT1)


SQL: dict[str, str] = {
    "week_calendar": "SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date, "
    f"{S.wyear('o_orderdate')} AS year, {S.wweek('o_orderdate')} AS week FROM orders",
    "calendar_trace": f"""
WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem ORDER BY d LIMIT 14),
t AS (SELECT d, make_date(year(d), 1, 1) AS j FROM days),
u AS (SELECT d, j, CAST(isodow(j) - 1 AS INTEGER) AS wd, CAST((6 - (isodow(j) - 1)) % 7 AS INTEGER) AS dus FROM t)
SELECT strftime(d, '%Y-%m-%d') AS date, strftime(d, '%A') AS day_name, CAST(year(d) AS INTEGER) AS calendar_year,
       strftime(j, '%Y-%m-%d') AS jan_1, wd AS jan_1_weekday, dus AS days_until_sunday,
       strftime(j + dus, '%Y-%m-%d') AS first_sunday, d < j + dus AS before_first_sunday,
       CAST(d - (j + dus) AS INTEGER) AS days_since_first_sunday, {S.wyear('d')} AS year, {S.wweek('d')} AS week
FROM u""",
    "extract_period": _CASES + f"SELECT period, TRY_CAST(regexp_extract(period, {S.q(S.PERIOD_RE)}, 2) AS INTEGER) AS Year, "
    f"TRY_CAST(regexp_extract(period, {S.q(S.PERIOD_RE)}, 1) AS INTEGER) AS Week FROM periods",
    "melt_cases": _CASES + "SELECT period, District, Cases FROM cases_melt",
    "scan_cases_wide": _CASES + "SELECT period, District, Cases FROM cases_melt",
    "scan_cases": _CASES + "SELECT * FROM cases_raw",
    "scan_malformed": _CASES.rstrip() + """,
landed AS (SELECT Week, concat_ws(',', Year, Week, District) AS cells, concat(',', coalesce(CAST(Cases AS VARCHAR), '')) AS one FROM cases_raw)
SELECT 'read' AS kind, CASE WHEN Week = 7 THEN concat(cells, ',') ELSE concat(cells, one) END AS record FROM landed WHERE Week <> 9
UNION ALL SELECT 'short', cells FROM landed WHERE Week = 7
UNION ALL SELECT 'long', concat(cells, one, ',late') FROM landed WHERE Week = 9""",
    "sink_cases_long": _CASES + "SELECT * FROM cases_raw",
    "standardize_names": _CASES + "SELECT DISTINCT District AS raw_name, " + S.std_name("District") + " AS District FROM cases_raw",
    "merge_districts": _CASES + "SELECT * FROM cases_m",
    "week_spine": _CASES + "SELECT * FROM spine",
    "complete_panel": _CASES + "SELECT * FROM base",
    "parse_dates": _EVERY_DAY + f"SELECT variable, part, src_row, time_text, {_TS.format('date')} AS date FROM parsed",
    "drop_invalid_dates": _SHEETS + "SELECT variable, part, count(*) AS rows, count(date) AS kept, CAST(count_if(date IS NULL) AS BIGINT) AS dropped "
    "FROM parsed GROUP BY variable, part",
    "coerce_numeric": _SHEETS + f"SELECT variable, part, src_row, station, text, {S.num('text')} AS value FROM sheet_cells",
    "union_parts": _SHEETS + f"SELECT variable, part, src_row, {_TS.format('date')} AS date FROM parsed WHERE date IS NOT NULL",
    "dedup_dates": _EVERY_DAY + f"SELECT variable, {_TS.format('date')} AS date, part, src_row FROM first_rows",
    "date_counts": _SHEETS + "SELECT variable, part, count(*) AS rows, count(date) AS kept, count(*) - count(date) AS dropped "
    "FROM parsed GROUP BY variable, part",
    "combine_parts": _SHEETS + f"SELECT variable, {_TS.format('date')} AS date, station, value FROM cells",
    "mean_temperature": S.with_ctes(S.NATIONS, S.WEATHER, S.MEAN_TEMP) + f"SELECT {_TS.format('date')} AS date, station, value FROM temp_cells",
    "empty_part": _SHEETS + f"""
SELECT k.variable, {_TS.format('k.date')} AS date, vs.station, {S.num('c.text')} AS value
FROM (SELECT * FROM (SELECT variable, part, src_row, try_strptime(time_text, '%d/%m/%Y %H:%M:%S') AS date FROM sheet_rows WHERE part = 1)
      WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variable, date ORDER BY src_row) = 1) k
JOIN var_stations vs ON vs.variable = k.variable
LEFT JOIN sheet_cells c ON c.variable = k.variable AND c.part = 1 AND c.src_row = k.src_row AND c.station = vs.station""",
    "mean_temperature_zip": S.with_ctes(S.NATIONS, S.WEATHER, S.MEAN_TEMP) + f"SELECT {_TS.format('date')} AS date, station, value FROM temp_cells",
    "mean_temperature_date": S.with_ctes(S.NATIONS, S.WEATHER, S.mean_temp(S.BY_DATE)) + f"SELECT {_TS.format('date')} AS date, station, value FROM temp_cells",
    "weekly_mean": S.with_ctes(S.NATIONS, S.WEATHER, S.MEAN_TEMP, S.WEEKLY) + "SELECT * FROM weekly WHERE variable <> 'precipitation'",
    "weekly_sum": S.with_ctes(S.NATIONS, S.WEATHER, S.MEAN_TEMP, S.WEEKLY) + "SELECT * FROM weekly WHERE variable = 'precipitation'",
    "streaming_weekly": S.with_ctes(S.NATIONS, S.WEATHER, S.MEAN_TEMP, S.WEEKLY) + "SELECT * FROM weekly",
    "lag_features": S.with_ctes(*S.ALL[:-1]) + "SELECT * FROM feats",
    "features_wide": _ALL + "SELECT * FROM fw",
    "integrate_panel": _ALL + "SELECT * FROM panel",
    "sink_panel": _ALL + "SELECT * FROM panel",
    "entry": _entry_sql(),
    "append_year": S.with_ctes(*[S.mean_temp(S.BY_DATE) if b is S.MEAN_TEMP else b for b in S.ALL]) + "SELECT * FROM panel",
    "forward_fill": _ALL + "SELECT * FROM panel",
    "ordered_panel": _ALL + "SELECT * FROM panel ORDER BY District, Year, Week",
    "station_long": S.with_ctes(*S.ALL[:-1]) + """
SELECT l.variable, m.district_name, l.year, l.week, l.value FROM weekly l JOIN vg ON vg.variable = l.variable
JOIN (SELECT """ + S.title(S.strip("district_name")) + """ AS district_name, station_group, station FROM map_long) m
  ON m.station_group = vg.station_group AND m.station = l.station""",
    "fill_cases": _CASES + "SELECT Year, Week, District, coalesce(Cases, 0.0) AS Cases FROM cases_raw",
    "first_week": _CASES + "SELECT Year, Week, sum(coalesce(Cases, 0.0)) AS Cases FROM cases_raw "
    "WHERE contains(District, 'NATION_2') GROUP BY Year, Week ORDER BY Year, Week LIMIT 1",
    "scan_panel": _ALL + "SELECT * FROM panel",
    "district_summary": _summary_sql(),
    "sink_summary": _summary_sql(),
    "completeness": _completeness_sql(),
    "null_counts": _null_counts_sql(),
    "join_coverage": _coverage_sql(),
    "cell_completeness": _cell_sql(),
    "zero_weeks": _CASES + "SELECT CAST(count_if(Cases = 0) AS BIGINT) AS zero_weeks, count(*) AS rows FROM base",
    "describe": _describe_sql(),
    "table_info": _CASES + """
SELECT 1 AS ordinal, 'Year' AS "column", 'int' AS type, count(Year) AS non_null FROM cases_raw
UNION ALL SELECT 2, 'Week', 'int', count(Week) FROM cases_raw
UNION ALL SELECT 3, 'District', 'string', count(District) FROM cases_raw
UNION ALL SELECT 4, 'Cases', 'double', count(Cases) FROM cases_raw""",
    "distinct_districts": _CASES + "SELECT 'cases' AS source, count(DISTINCT District) AS districts FROM cases_m "
    "UNION ALL SELECT 'panel', count(DISTINCT District) FROM base",
    "panel_extent": _ALL + "SELECT count(*) AS rows, 29 AS columns, min(Year) AS min_year, min(Week) AS min_week, "
    "max(Year) AS max_year, max(Week) AS max_week, count(DISTINCT District) AS districts, sum(Cases) AS total_cases FROM panel",
    "national_by_year": _CASES + "SELECT Year, coalesce(sum(coalesce(Cases, 0)), 0.0) AS Cases FROM cases_raw GROUP BY Year",
    "national_by_week": _CASES + "SELECT Year, Week, coalesce(sum(coalesce(Cases, 0)), 0.0) AS Cases FROM cases_raw GROUP BY Year, Week",
    "cases_by_district": _CASES + "SELECT District, coalesce(sum(coalesce(Cases, 0)), 0.0) AS Cases FROM cases_raw GROUP BY District",
    "filtered_total": _CASES + "SELECT coalesce(sum(CASE WHEN contains(District, 'NATION_2') THEN coalesce(Cases, 0) END), 0.0) AS total FROM cases_raw",
    "filter_contains": _CASES + "SELECT * FROM cases_raw WHERE coalesce(contains(District, 'NATION_1'), false)",
    "filter_equals": _ALL + "SELECT * FROM panel WHERE District = 'Nation_1'",
    "filter_week": _ALL + "SELECT * FROM panel WHERE District = 'Nation_2' AND Year = 1997 AND Week = 10",
    "fill_all": _CASES + "SELECT coalesce(Year, 0) AS Year, coalesce(Week, 0) AS Week, coalesce(District, '0') AS District, "
    "coalesce(Cases, 0.0) AS Cases FROM cases_raw",
    "pivot_year_district": _CASES + "SELECT Year, " + ", ".join(
        f"coalesce(sum(CASE WHEN District = '{d}' THEN coalesce(Cases, 0.0) END), 0.0) AS \"{d}\"" for d in PIVOT_DISTRICTS
    ) + " FROM cases_raw GROUP BY Year",
    "pivot_district_year": _CASES + "SELECT District, " + ", ".join(
        f"coalesce(sum(CASE WHEN Year = {y} THEN coalesce(Cases, 0.0) END), 0.0) AS \"{y}\"" for y in PIVOT_YEARS
    ) + " FROM cases_raw GROUP BY District",
    "top_districts": _CASES + "SELECT District, coalesce(sum(coalesce(Cases, 0)), 0.0) AS Cases FROM cases_raw GROUP BY District "
    "ORDER BY Cases DESC, District LIMIT 20",
    "sample_rows": _ALL + "SELECT * FROM panel ORDER BY District, Year, Week LIMIT 5",
    "reconcile_totals": _ALL.rstrip() + """,
rs AS (SELECT District, coalesce(sum(coalesce(Cases, 0)), 0.0) AS raw_total FROM cases_std GROUP BY District),
ps AS (SELECT District, sum(Cases) AS panel_total FROM panel GROUP BY District)
SELECT coalesce(rs.District, ps.District) AS District, raw_total, panel_total,
       coalesce(raw_total = panel_total, false) AS passed
FROM rs FULL JOIN ps ON rs.District = ps.District""",
    "reconcile_week": _ALL.rstrip() + """,
sums AS (SELECT District, Year, Week, sum(coalesce(Cases, 0)) AS raw_cases FROM cases_std
         WHERE District IS NOT NULL AND Year IS NOT NULL AND Week IS NOT NULL GROUP BY District, Year, Week),
firsts AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY District ORDER BY Year, Week) = 1),
pw AS (SELECT District, Year, Week, sum(Cases) AS panel_cases FROM panel GROUP BY District, Year, Week)
SELECT f.District, f.Year, f.Week, f.raw_cases, coalesce(pw.panel_cases, 0.0) AS panel_cases,
       f.raw_cases = coalesce(pw.panel_cases, 0.0) AS passed
FROM firsts f LEFT JOIN pw ON pw.District = f.District AND pw.Year = f.Year AND pw.Week = f.Week""",
    "week_drilldown": S.with_ctes(S.NATIONS, S.WEATHER, S.MEAN_TEMP, S.MAPPING) + f"""
, st AS (SELECT temp_station FROM map_raw WHERE upper({S.strip('district_name')}) = 'NATION_1' ORDER BY src_row LIMIT 1),
dd AS (SELECT {S.wyear('date')} AS year, {S.wweek('date')} AS week, CAST(date AS DATE) AS day, value
       FROM temp_cells WHERE station IN (SELECT temp_station FROM st)),
fy AS (SELECT min(year) AS fy FROM dd)
SELECT year, week, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day,
       count(*) AS days, count(value) AS n_values, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS value_sum,
       CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) / nullif(count(value), 0) AS value_mean,
       coalesce(string_agg(CAST(value AS VARCHAR), ', ' ORDER BY day), '') AS daily_values
FROM dd, fy WHERE year = fy AND week <= 2 GROUP BY year, week""".replace("\n, st AS", ",\nst AS"),
    "map_stations": S.with_ctes(S.NATIONS, S.WEATHER, S.MAPPING) + f"""
SELECT vg.variable, m.district_name, m.station FROM vg JOIN map_long m ON m.station_group = vg.station_group
WHERE EXISTS (SELECT 1 FROM ({_TEMP_STATIONS_AS_TEMP}) h WHERE h.variable = vg.variable AND h.station = m.station)""",
    "missing_stations": _MISS + "SELECT station_group, district_code, station FROM miss",
    "missing_stations_top": _MISS + """
SELECT station_group, position, district_code, station, total, greatest(total - 10, 0) AS more FROM (
  SELECT station_group, district_code, station,
         CAST(row_number() OVER (PARTITION BY station_group ORDER BY src_row) AS INTEGER) AS position,
         count(*) OVER (PARTITION BY station_group) AS total FROM miss)
WHERE position <= 10""",
    "dedup_mapping": _MAP + "SELECT * FROM map_dedup",
    "standardize_mapping": _MAP + "SELECT * FROM map_std",
    "normalize_codes": _MAP + "SELECT src_row, district_code FROM map_std",
    "table_shape": S.with_ctes(S.NATIONS, S.CASES, S.WEATHER, S.MAPPING) + """
SELECT 'cases' AS "table", count(*) AS rows, 4 AS columns FROM cases_raw
UNION ALL SELECT 'mapping', count(*), 6 FROM map_raw
UNION ALL SELECT variable || '_part' || part, count(*), 14 FROM sheet_rows GROUP BY variable, part""",
    "station_catalog": _SHEETS + """
SELECT s.variable, s.part, CAST(row_number() OVER (PARTITION BY s.variable, s.part ORDER BY s.nk) AS INTEGER) AS ordinal,
       s.station || CASE WHEN s.part = 2 THEN ' ' ELSE '' END AS station, c.non_null
FROM stations s JOIN (SELECT variable, part, station, count(text) AS non_null FROM sheet_cells GROUP BY ALL) c
  ON c.variable = s.variable AND c.part = s.part AND c.station = s.station""",
    "trim_columns": _SHEETS + """
SELECT variable, part, 1 AS ordinal, 'Time (NPT)' AS header, 'Time (NPT)' AS trimmed, count(time_text) AS non_null
FROM sheet_rows GROUP BY variable, part
UNION ALL
SELECT s.variable, s.part, CAST(1 + row_number() OVER (PARTITION BY s.variable, s.part ORDER BY s.nk) AS INTEGER),
       s.station || CASE WHEN s.part = 2 THEN ' ' ELSE '' END, s.station, c.non_null
FROM stations s JOIN (SELECT variable, part, station, count(text) AS non_null FROM sheet_cells GROUP BY ALL) c
  ON c.variable = s.variable AND c.part = s.part AND c.station = s.station""",
    "column_dictionary": S.with_ctes(S.NATIONS, S.WEATHER, S.MAPPING) + """
SELECT variable || '_part' || part AS "table", 1 AS ordinal, 'Time (NPT)' AS "column", 'string' AS type, count(time_text) AS non_null
FROM sheet_rows GROUP BY variable, part
UNION ALL
SELECT s.variable || '_part' || s.part, CAST(1 + row_number() OVER (PARTITION BY s.variable, s.part ORDER BY s.nk) AS INTEGER),
       s.station || CASE WHEN s.part = 2 THEN ' ' ELSE '' END, 'string', c.non_null
FROM stations s JOIN (SELECT variable, part, station, count(text) AS non_null FROM sheet_cells GROUP BY ALL) c
  ON c.variable = s.variable AND c.part = s.part AND c.station = s.station
UNION ALL SELECT 'mapping', 1, 'district_code', 'string', count(district_code) FROM map_raw
UNION ALL SELECT 'mapping', 2, 'district_name', 'string', count(district_name) FROM map_raw
UNION ALL SELECT 'mapping', 3, 'temp_station', 'string', count(temp_station) FROM map_raw
UNION ALL SELECT 'mapping', 4, 'humidity_station', 'string', count(humidity_station) FROM map_raw
UNION ALL SELECT 'mapping', 5, 'precipitation_station', 'string', count(precipitation_station) FROM map_raw""",
    "date_positions": _SHEETS + f"""
SELECT variable, {_TS.format('date')} AS date, row_number() OVER (PARTITION BY variable ORDER BY date) - 1 AS pos
FROM first_rows WHERE variable IN ('temp_max', 'temp_min')""",
    "scan_mapping": _MAP + "SELECT district_code, district_name, temp_station, humidity_station, precipitation_station FROM map_raw",
    "scan_daily_wide": _SHEETS + "SELECT variable, part, time_text, station, text FROM sheet_cells",
}
