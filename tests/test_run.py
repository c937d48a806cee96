"""The panel build as a job: resuming, joint publishing, clean-up, one more year."""

import os

import pytest
from pyspark.sql import functions as F

from weekpanel import session
from weekpanel.plans import run, standin
from weekpanel.plans.integrate import Inputs, build_panel
from weekpanel.session import scratch_path

from .conftest import SF_SMALL
from .test_combine import part1, part2


@pytest.fixture()
def inputs(spark):
    cases = spark.createDataFrame([(2024, 1, "101 DELTA", 4.0), (2024, 3, "DELTA", 1.0)], "Year int, Week int, District string, Cases double")
    mapping = spark.createDataFrame(
        [(" 101", "delta", "a", "s", "b", 0), ("102", "Ghost", "zz", None, "b", 1)],
        "district_code string, district_name string, temp_station string, humidity_station string, precipitation_station string, src_row long")
    return Inputs(cases, {v: [part1(spark), part2(spark)] for v in ("temp_max", "temp_min", "humidity", "precipitation")}, mapping)


def listed(*names):
    return sorted(n for n in os.listdir(os.path.join(*names).removeprefix("file:")) if not n.startswith("."))


class Killed(Exception):
    pass


def killed(*_):
    raise Killed


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b.select(*a.columns)).isEmpty()


def test_a_killed_run_goes_on_from_its_last_stage(spark, inputs, monkeypatch):
    out = scratch_path(spark, "t-run")
    before = list(session._SCRATCH)
    with monkeypatch.context() as m:
        m.setattr(run.PanelRun, "_summary", killed)
        with pytest.raises(Killed):
            run.PanelRun(spark, inputs, out).run()
    with pytest.raises(run.Unpublished):
        run.published(spark, out)
    assert listed(out, "_staging") == ["base", "combined", "panel", "weekly"]
    with monkeypatch.context() as m:  # the stages that were whole are not computed again
        for stage in ("_combined", "_weekly", "_base", "_panel"):
            m.setattr(run.PanelRun, stage, killed)
        run.PanelRun(spark, inputs, out).run()
    assert run.published(spark, out)["stages"] == ["combined", "weekly", "base", "panel", "summary", "completeness"]
    assert listed(out) == ["_manifest.json", "completeness", "panel", "summary", "weekly"]
    assert session._SCRATCH == before  # nothing but the outputs is left
    assert same(run.read_output(spark, out, "panel"), build_panel(inputs))
    assert run.read_output(spark, out, "summary").first().Cases_count == 52
    assert [tuple(r)[:2] for r in run.published(spark, out)["counts"]][:2] == [("temp_max", 1), ("temp_max", 2)]
    got = {(r.section, r.item): (r.total, r.n) for r in run.report(spark, inputs, out).collect()}
    assert got["districts without station", "humidity"] == (2, 1) and got["districts without station", "temp"] == (2, 1)
    assert got["rows with cases", "panel"] == (52, 2)


def test_a_run_killed_while_publishing_is_completed(spark, inputs, monkeypatch):
    out = scratch_path(spark, "t-run")
    run.PanelRun(spark, inputs, out).run()
    changed = run.Options(empty_sum="null")
    real, moves = run.Folder.move, []

    def second_fails(self, old, new):
        if old[0] == "_staging":
            moves.append(old)
            if len(moves) == 2:
                raise Killed
        real(self, old, new)

    with monkeypatch.context() as m:
        m.setattr(run.Folder, "move", second_fails)
        with pytest.raises(Killed):
            run.PanelRun(spark, inputs, out, changed).run()
    with pytest.raises(run.Unpublished):  # half of it is in place
        run.read_output(spark, out, "panel")
    run.PanelRun(spark, inputs, out, changed).run()
    assert same(run.read_output(spark, out, "panel"), build_panel(inputs, empty_sum="null"))


def test_a_published_run_is_not_repeated(spark, inputs, monkeypatch):
    out = scratch_path(spark, "t-run")
    run.PanelRun(spark, inputs, out).run()
    with monkeypatch.context() as m:
        m.setattr(run.PanelRun, "_combined", killed)
        run.PanelRun(spark, inputs, out).run()
        for again in ({"force": True}, {"options": run.Options(align="date")}):
            with pytest.raises(Killed):
                run.PanelRun(spark, inputs, out, **again).run()


def test_dropped_dates_are_counted(spark, inputs):
    from weekpanel.plans.integrate import combine_inputs

    bad = spark.createDataFrame([("1/2/2024", "1", 0), ("soon", "2", 1), (None, "3", 2)], "time string, s string, src_row long")
    inputs.sheets = {"humidity": [bad, bad.limit(0)]}
    assert combine_inputs(inputs).counts() == [("humidity", 1, 3, 1, 2), ("humidity", 2, 0, 0, 0)]


@pytest.fixture(scope="module")
def grown(spark):
    """A panel without its last year, and that year added; full inputs."""
    out = scratch_path(spark, "t-grown")
    nations = standin.nation_dimension(spark, SF_SMALL)
    before, after = (standin.inputs(spark, SF_SMALL, nations=nations, years=y) for y in ((0, 2000), (2001, 2001)))
    run.PanelRun(spark, before, out, run.Options(align="date")).run()
    files = {d: listed(out, "panel", d) for d in listed(out, "panel") if d.startswith("Year")}
    run.append_year(spark, after, out, 2001)
    return out, files, standin.inputs(spark, SF_SMALL, nations=nations), after


def test_adding_a_year_equals_a_full_build(spark, grown):
    out, files, full, _ = grown
    panel = run.read_output(spark, out, "panel")
    assert same(panel, build_panel(full, align="date")) and panel.filter("Year = 2001").count() > 0
    assert {d: listed(out, "panel", d) for d in files} == files  # other years' folders are untouched
    assert run.read_output(spark, out, "summary").agg(F.max("Year_max")).first()[0] == 2001


def test_a_year_that_would_change_others_is_refused(spark, grown):
    out, _, full, after = grown
    from dataclasses import replace

    with pytest.raises(run.NeedsFullBuild, match="year after"):
        run.append_year(spark, after, out, 2005)
    with pytest.raises(run.NeedsFullBuild, match="stations"):
        run.append_year(spark, replace(after, sheets={"humidity": after.sheets["humidity"]}), out, 2001)
    strange = after.cases_raw.withColumn("District", F.lit("Elsewhere"))
    with pytest.raises(run.NeedsFullBuild, match="districts"):
        run.append_year(spark, replace(after, cases_raw=strange), out, 2001)
    with pytest.raises(run.Unpublished):
        run.append_year(spark, after, scratch_path(spark, "nothing"), 2001)
