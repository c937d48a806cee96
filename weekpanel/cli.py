"""Command line: run the panel jobs on landed files.

    python -m weekpanel.cli integrate --cases cases.csv --mapping mapping.csv \\
        --sheet temp_max=max1.csv,max2.csv --sheet temp_min=min1.csv,min2.csv \\
        --sheet humidity=rh1.csv,rh2.csv --sheet precipitation=p1.csv,p2.csv --out out/
    python -m weekpanel.cli append --year 2025 <the same inputs, with that year's rows> --out out/
    python -m weekpanel.cli validate --cases cases.csv --panel out/panel
    python -m weekpanel.cli stations --mapping mapping.csv --sheet temp_max=max1.csv ...
    python -m weekpanel.cli preprocess --wide cases_wide.csv --out cases_long/
    python -m weekpanel.cli eda --cases cases.csv

Sheets are CSV files with a header (first column = time text); a missing
input path, an absent column or a sheet without a valid date ends with a
one-line message and exit code 2.  ``integrate`` is a resumable job (see
:mod:`weekpanel.plans.run`): started again after a failure it goes on from its last
whole stage.  Reports are printed whole, row by row;
``--rows N`` prints the first N and says how many there are.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.functions.calendar import calendar_trace
from weekpanel.functions.dates import NoValidDate
from weekpanel.functions.text import strip_ws
from weekpanel.operators import quality as Q
from weekpanel.operators.clean import fill_all
from weekpanel.operators.features import prepare_mapping, unmatched_stations
from weekpanel.operators.reshape import cases_long_from_wide, pivot_district_year
from weekpanel.plans import run
from weekpanel.plans.integrate import Inputs, combine_inputs, observations
from weekpanel.schemas import STATION_GROUP, VARIABLES, feature_columns
from weekpanel.session import apply_engine_conf, ensure_checkpoint_dir, scratch_scope
from weekpanel.sources.readers import (MissingColumn, MissingInput, malformed_rows, scan_cases, scan_cases_wide, scan_daily_wide,
                                       scan_mapping, scan_panel)
from weekpanel.sources.sinks import write_cases_long


def _sheets(specs: list[str], spark: SparkSession) -> dict[str, list[DataFrame]]:
    out: dict[str, list[DataFrame]] = {}
    for spec in specs or []:
        variable, _, paths = spec.partition("=")
        if variable.strip() not in STATION_GROUP:
            raise MissingInput(f"unknown sheet variable {variable.strip()!r}; known: {', '.join(STATION_GROUP)}")
        out[variable.strip()] = [scan_daily_wide(spark, p) for p in paths.split(",") if p]
    return out


def _aliases(specs: list[str] | None) -> dict[str, str]:
    """The fixed alias table, extended by ``--alias SOURCE=TARGET`` options."""
    from weekpanel.schemas import DISTRICT_ALIASES

    extra = dict(spec.split("=", 1) for spec in specs or [])
    return {**DISTRICT_ALIASES, **{k.strip().upper(): v.strip() for k, v in extra.items()}}


def _show(title: str, df: DataFrame, order: list | None = None, rows: int | None = None) -> None:
    """Print a report; ``rows`` bounds what is printed, and then the total is printed too."""
    ordered = df.orderBy(*order) if order else df
    print(f"\n{title}")
    printed = 0
    for r in (ordered if rows is None else ordered.limit(rows)).toLocalIterator():
        print("  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()))
        printed += 1
    if not printed:
        print("  (none)")
    if rows is not None and printed == rows:
        print(f"  ({printed} of {df.count()} rows)")


def _inputs(spark: SparkSession, a) -> Inputs:
    return Inputs(cases_raw=scan_cases(spark, a.cases), sheets=_sheets(a.sheet, spark), mapping=scan_mapping(spark, a.mapping),
                  aliases=_aliases(a.alias), per_row=a.per_row, infer=a.infer, strict=True, either=a.either)


def _quarantine(spark: SparkSession, a) -> None:
    """Rows whose number of cells is not the header's: written whole, and counted."""
    paths = [a.cases, a.mapping, *[p for spec in a.sheet for p in spec.partition("=")[2].split(",") if p]]
    bad = None
    for path in paths:
        one = malformed_rows(spark, path)
        bad = one if bad is None else bad.unionByName(one)
    out = os.path.join(a.out, "quarantine")
    bad.write.mode("overwrite").parquet(out)
    written = spark.read.schema(bad.schema).parquet(out)
    _show("Malformed rows by file (short rows are kept, long rows are left out)", written.groupBy("file", "kind").count(), ["file", "kind"], a.rows)


def cmd_integrate(spark: SparkSession, a) -> None:
    inputs = _inputs(spark, a)
    weeks = a.weeks if a.weeks == "calendar" else int(a.weeks)
    options = run.Options(a.align, a.mode, a.empty_sum, a.lag_by, weeks, a.format)
    run.PanelRun(spark, inputs, a.out, options, force=a.force).run()
    _reports(spark, inputs, a)


def cmd_append(spark: SparkSession, a) -> None:
    inputs = _inputs(spark, a)
    run.append_year(spark, inputs, a.out, a.year)
    _reports(spark, inputs, a)


def _reports(spark: SparkSession, inputs: Inputs, a) -> None:
    held = run.published(spark, a.out)
    panel = run.read_output(spark, a.out, "panel")
    counts = spark.createDataFrame([tuple(r) for r in held["counts"]], "variable string, part int, rows long, kept long, dropped long")
    _show("Dates by sheet", counts, ["variable", "part"], a.rows)
    _quarantine(spark, a)
    lost = unmatched_stations(prepare_mapping(inputs.mapping, inputs.aliases), held["stations"]).filter("missing")
    _show("Districts whose station is not in the data (first 5 per variable)",
          Q.first_n_per_group(lost, "variable", ["district_name"], 5).select("variable", "position", "district_name", "station", "total", "more"),
          ["variable", "position"])
    missing = run.read_output(spark, a.out, "completeness").withColumn("percentage", Q.percent_text("missing_pct"))
    _show("Missing data by column", missing.select("column", "missing", "percentage"), [F.desc("missing"), "column"], a.rows)
    _show("Weather cell completeness", Q.cell_completeness(panel, feature_columns()))
    _show("Rows with a weather value, by variable", Q.join_coverage(panel, VARIABLES), ["variable"])
    _show("Weeks without cases", Q.zero_weeks(panel))
    _show("Overview", Q.panel_extent(panel))
    if a.trace:
        _trace(spark, inputs, a)


def _trace(spark: SparkSession, inputs: Inputs, a) -> None:
    """The calendar of the first 14 days and the first two weeks of one district's mean temperature."""
    named = F.upper(strip_ws("district_name")) == a.trace.strip().upper()
    station = inputs.mapping.filter(named).orderBy("src_row").select("district_code", "temp_station").limit(1)
    _show(f"Station of {a.trace}", station)
    daily = observations(inputs, a.align, combine_inputs(inputs, hold="none", mode=a.mode)).filter(F.col("variable") == "temp")
    days = daily.select("date").distinct().orderBy("date").limit(14)
    _show("Calendar of the first 14 days", calendar_trace(days), ["date"])
    series = daily.join(F.broadcast(station), F.col("station") == F.col("temp_station"), "left_semi")
    _show("First two weeks", Q.week_drilldown(series.select("date", "value"), 2), ["year", "week"])


def cmd_validate(spark: SparkSession, a) -> None:
    from weekpanel.functions.text import standardize_name

    raw = scan_cases(spark, a.cases)
    raw = raw.withColumn("District", standardize_name("District", _aliases(a.alias)))
    panel = scan_panel(spark, a.panel, fmt=a.format)
    checks = Q.reconcile_totals(raw, panel)
    _show("Districts whose raw and panel totals differ", checks.filter(~F.col("passed")), ["District"], a.rows)
    _show("Totals", checks.agg(F.count(F.lit(1)).alias("districts"), F.count_if("passed").alias("passed")))
    _show("First week per district, failing", Q.reconcile_week(raw, panel).filter(~F.col("passed")), ["District"], a.rows)


def cmd_stations(spark: SparkSession, a) -> None:
    # like the original diagnostic: the first part of one variable per group, headers as written
    listed = Q.station_catalog(spark, _sheets(a.sheet, spark), parts=None if a.all_parts else [1], trim=a.all_parts)
    catalog = (listed if a.all_parts else Q.group_catalog(listed)).select("station_group", "ordinal", "station")
    if a.all_parts:
        catalog = catalog.groupBy("station_group", "station").agg(F.min("ordinal").alias("ordinal")).select("station_group", "ordinal", "station")
    _show("Stations", catalog, ["station_group", "ordinal"], a.rows)
    _show("Stations per group", catalog.groupBy("station_group").count(), ["station_group"])
    mapping = scan_mapping(spark, a.mapping)
    groups = sorted(set(STATION_GROUP.values()))
    long = mapping.unpivot(["district_code", "src_row"], groups, "station_group", "station")
    miss = long.join(catalog, ["station_group", "station"], "left_anti")
    _show("Mapping stations not found (first 10 per group, file order)",
          Q.first_n_per_group(miss, "station_group", ["src_row"], 10)
          .select("station_group", "position", "district_code", "station", "total", "more"),
          ["station_group", "position"])


def cmd_preprocess(spark: SparkSession, a) -> None:
    long = cases_long_from_wide(scan_cases_wide(spark, a.wide))
    write_cases_long(long, a.out)
    _show("Cases by district", long.groupBy("District").agg(F.sum("Cases").alias("Cases")), ["District"], a.rows)


def cmd_eda(spark: SparkSession, a) -> None:
    cases = scan_cases(spark, a.cases)
    _show("Columns", Q.table_info(cases), ["ordinal"])
    _show("Describe", Q.describe(cases))
    _show("Missing", Q.null_counts(cases), ["ordinal"])
    _show("Shape", cases.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(cases.columns)).alias("columns")))
    filled = fill_all(cases)
    _show("Cases per year", filled.groupBy("Year").agg(F.sum("Cases").alias("Cases")), ["Year"])
    by_district = filled.groupBy("District").agg(F.sum("Cases").alias("Cases"))
    _show("Cases per district", by_district, ["District"], a.rows)
    years = [r["Year"] for r in filled.select("Year").distinct().orderBy("Year").collect()]  # a row per year
    if years:
        _show("Cases per district and year", pivot_district_year(filled, years), ["District"], a.rows)
    _show("Cases per year and district", filled.groupBy("Year", "District").agg(F.sum("Cases").alias("Cases")), ["Year", "District"], a.rows)
    _show("Top 20 districts", Q.top_n(by_district, 20, "Cases", "District"), [F.desc("Cases"), "District"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weekpanel")
    sub = p.add_subparsers(dest="cmd", required=True)
    i, ap = sub.add_parser("integrate"), sub.add_parser("append")
    for x in (i, ap):
        x.add_argument("--cases", required=True)
        x.add_argument("--mapping", required=True)
        x.add_argument("--sheet", action="append", required=True, help="variable=part1.csv,part2.csv")
        x.add_argument("--out", required=True)
        x.add_argument("--align", default="position", choices=["position", "date"])
        x.add_argument("--alias", action="append", help="extra name alias SOURCE=TARGET (repeatable)")
        x.add_argument("--mode", default="first_row", choices=["first_row", "coalesce"], help="duplicate dates across parts")
        x.add_argument("--per-row", dest="per_row", action="store_true", help="every row tries all date formats")
        x.add_argument("--infer", action="store_true", help="a sheet that no date format fits tries day-first formats")
        x.add_argument("--either", action="store_true", help="a mean temperature with one missing side takes the other")
        x.add_argument("--trace", metavar="DISTRICT", help="print the calendar and the first two weeks of a district's station")
    i.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    i.add_argument("--empty-sum", dest="empty_sum", default="zero", choices=["zero", "null"])
    i.add_argument("--lag-by", dest="lag_by", default="rows", choices=["rows", "calendar"])
    i.add_argument("--weeks", default="52", help="52 (default) or 'calendar'")
    i.add_argument("--force", action="store_true", help="build anew even if the inputs are those of the result at --out")
    ap.add_argument("--year", type=int, required=True, help="the year to add to the panel at --out (with the options it was built with)")
    v = sub.add_parser("validate")
    v.add_argument("--cases", required=True)
    v.add_argument("--panel", required=True)
    v.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    v.add_argument("--alias", action="append", help="extra name alias SOURCE=TARGET (repeatable)")
    s = sub.add_parser("stations")
    s.add_argument("--mapping", required=True)
    s.add_argument("--sheet", action="append", required=True)
    s.add_argument("--all-parts", dest="all_parts", action="store_true", help="look at all parts and variables, headers trimmed")
    pp = sub.add_parser("preprocess")
    pp.add_argument("--wide", required=True)
    pp.add_argument("--out", required=True)
    e = sub.add_parser("eda")
    e.add_argument("--cases", required=True)
    for x in (i, ap, v, s, pp, e):
        x.add_argument("--rows", type=int, default=None, help="print at most so many rows of a report, and their total")
        x.add_argument("--scratch", help="folder for intermediate tables, shared by driver and executors")
    return p


COMMANDS = {"integrate": cmd_integrate, "append": cmd_append, "validate": cmd_validate, "stations": cmd_stations,
            "preprocess": cmd_preprocess, "eda": cmd_eda}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        spark = SparkSession.builder.appName(f"weekpanel-{a.cmd}").getOrCreate()
    apply_engine_conf(spark)
    if a.scratch:
        spark.sparkContext.setCheckpointDir(a.scratch)
    ensure_checkpoint_dir(spark)
    try:
        with scratch_scope(spark):
            COMMANDS[a.cmd](spark, a)
    except (MissingInput, MissingColumn, NoValidDate, run.NeedsFullBuild, run.Unpublished) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
