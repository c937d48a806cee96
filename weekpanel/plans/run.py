"""The panel build as a resumable job, and the addition of one year to its result.

A run writes each stage under ``<out>/_staging`` and notes it in ``<out>/_manifest.json``
once it is whole.  A run that died is started again with the same arguments: stages in
the manifest are read back, the others are computed.  When all are staged, the outputs
are published together: the manifest says ``publishing`` first, then folders are
renamed, and a run that died in between completes the renames.  Readers that must not
meet a half-published result ask :func:`published`.  Scratch folders and staged stages
that are no output go at the end.

    stage         what                                                    published
    combined      kept rows of all sheets, with counts of dropped dates
    weekly        weekly values by station, in folders by year             yes
    base          the case panel
    panel         the panel, in folders by ``Year``                        yes
    summary       statistics per district                                  yes
    completeness  missing values by column                                 yes

A manifest belongs to one set of inputs: the options, the headers and the names,
lengths and times of the files read (tables without files are told apart by their
headers only; ``force=True`` builds anew).
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weekpanel.functions.calendar import week_year
from weekpanel.operators import quality as Q
from weekpanel.operators.combine import ROWS, Combined, combine_many
from weekpanel.operators.features import lag_features, prepare_mapping, unmatched_stations
from weekpanel.operators.panel import complete_panel, features_wide, forward_fill, integrate_panel
from weekpanel.operators.rollup import weekly_rollup
from weekpanel.plans.integrate import SHEET_VARIABLES, Inputs, base_panel, clean_cases, observations
from weekpanel.schemas import LAG_WEEKS, PANEL, PANEL_KEYS, feature_columns
from weekpanel.session import file_system, scratch_scope
from weekpanel.sources.readers import scan_panel
from weekpanel.sources.sinks import write_panel, write_summary

WEEKLY = "variable string, station string, year int, week int, value double"
OUTPUTS = ("weekly", "panel", "summary", "completeness")


class NeedsFullBuild(ValueError):
    """A year cannot be added to a published panel without changing its other years."""


class Unpublished(RuntimeError):
    """There is no whole result at this place."""


@dataclass(frozen=True)
class Options:
    align: str = "position"
    mode: str = "first_row"
    empty_sum: str = "zero"
    lag_by: str = "rows"
    weeks: int | str = 52
    fmt: str = "parquet"  # of the panel; one year can be added to Parquet only


class Folder:
    """A folder in any store that Spark reads, with the few operations a run needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs, _ = file_system(spark, path)

    def at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *names))

    def name(self, *names: str) -> str:
        return os.path.join(self.path, *names)

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self.at(*names))

    def remove(self, *names: str) -> None:
        self.fs.delete(self.at(*names), True)

    def move(self, old: tuple[str, ...], new: tuple[str, ...]) -> None:
        self.fs.mkdirs(self.at(*new).getParent())
        if not self.fs.rename(self.at(*old), self.at(*new)):
            raise OSError(f"cannot rename {self.name(*old)} to {self.name(*new)}")

    def read_json(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_json(self, name: str, value: dict) -> None:
        """Whole or not at all: written beside and renamed."""
        stream = self.fs.create(self.at(name + ".new"), True)
        try:
            stream.write(bytearray(json.dumps(value, indent=1).encode()))
        finally:
            stream.close()
        self.remove(name)
        self.move((name + ".new",), (name,))


def _fingerprint(spark: SparkSession, inputs: Inputs, options: Options) -> str:
    """Of the options, the headers and the files behind the inputs."""
    def of(df: DataFrame) -> list:
        files = []
        for path in sorted(df.inputFiles()):
            fs, where = file_system(spark, path)
            status = fs.getFileStatus(where)
            files.append([path, status.getLen(), status.getModificationTime()])
        return [df.schema.simpleString(), files]

    switches = [inputs.aliases, inputs.per_row, inputs.infer, inputs.strict, inputs.either]
    tables = [of(inputs.cases_raw), of(inputs.mapping), {v: [of(s) for s in parts] for v, parts in inputs.sheets.items()}]
    return hashlib.sha256(json.dumps([asdict(options), switches, tables], sort_keys=True).encode()).hexdigest()


class PanelRun:
    """One build of the panel into ``out``; see the module."""

    def __init__(self, spark: SparkSession, inputs: Inputs, out: str, options: Options = Options(), force: bool = False):
        self.spark, self.inputs, self.options = spark, inputs, options
        self.folder = Folder(spark, out)
        mark = _fingerprint(spark, inputs, options)
        held = self.folder.read_json("_manifest.json")
        if held and held["fingerprint"] == mark and not force:
            self.manifest = held
        else:
            if held and held["state"] == "publishing":
                _complete(self.folder, held)  # what was promised before is whole first
            self.folder.remove("_staging")
            self.manifest = {"fingerprint": mark, "state": "building", "stages": [], "options": asdict(options)}

    def run(self) -> None:
        """Computes what is missing and publishes; nothing if the result is published already."""
        if self.manifest["state"] == "published":
            return
        if self.manifest["state"] == "building":
            with scratch_scope(self.spark):
                for name, make in self.stages():
                    if name not in self.manifest["stages"]:
                        self.folder.remove("_staging", name)
                        make(self.folder.name("_staging", name))
                        self.manifest["stages"].append(name)
                        self._note()
            self.manifest["state"] = "publishing"
            self._note()
        _complete(self.folder, self.manifest)

    def _note(self) -> None:
        self.folder.write_json("_manifest.json", self.manifest)

    def stages(self) -> list[tuple[str, Callable[[str], None]]]:
        return [(n, getattr(self, f"_{n}")) for n in ("combined", "weekly", "base", "panel", "summary", "completeness")]

    # ------------------------------------------------------------- stages
    def _staged(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.folder.name("_staging", name))

    def _combined(self, path: str) -> None:
        i, seen = self.inputs, Observation()
        c = combine_many({v: i.sheets[v] for v in SHEET_VARIABLES if v in i.sheets}, mode=self.options.mode,
                         per_row=i.per_row, infer=i.infer, observation=seen)
        c.rows.write.mode("overwrite").parquet(path)
        if c.sheets:
            self.manifest["counts"] = [list(r) for r in c.counts()]
            if i.strict:
                c.check_dates()
        else:
            self.manifest["counts"] = []
        dates = self.spark.read.schema(ROWS).parquet(path).groupBy("variable").count().collect()  # a row per variable
        self.manifest |= {"stations": c.stations, "dates": {r["variable"]: r["count"] for r in dates}}

    def _weekly(self, path: str) -> None:
        rows = Combined(self._staged("combined", ROWS), self.manifest["stations"])
        weekly = weekly_rollup(observations(self.inputs, self.options.align, rows), empty_sum=self.options.empty_sum)
        _write_weekly(weekly, path)

    def _base(self, path: str) -> None:
        base_panel(self.inputs, self.options.weeks).write.mode("overwrite").parquet(path)

    def _panel(self, path: str) -> None:
        mapping = prepare_mapping(self.inputs.mapping, self.inputs.aliases)
        features = lag_features(self._staged("weekly", WEEKLY), mapping, by=self.options.lag_by)
        base = self._staged("base", "Year int, Week int, District string, Cases double")
        write_panel(integrate_panel(base, features), path, fmt=self.options.fmt)

    def _summary(self, path: str) -> None:
        write_summary(Q.district_summary(self._written_panel()), path)

    def _completeness(self, path: str) -> None:
        Q.completeness(self._written_panel()).coalesce(1).write.mode("overwrite").parquet(path)

    def _written_panel(self) -> DataFrame:
        return scan_panel(self.spark, self.folder.name("_staging", "panel"), fmt=self.options.fmt)


def _write_weekly(weekly: DataFrame, path: str, dynamic: bool = False) -> None:
    writer = weekly.hint("rebalance", "year").write.mode("overwrite").partitionBy("year")
    (writer.option("partitionOverwriteMode", "dynamic") if dynamic else writer).parquet(path)


def _complete(folder: Folder, manifest: dict) -> None:
    """Renames staged outputs into place.  Each step may have been done before the run died."""
    for name in OUTPUTS:
        if folder.exists("_staging", name):
            folder.remove(name)
            folder.move(("_staging", name), (name,))
    folder.remove("_staging")
    manifest["state"] = "published"
    folder.write_json("_manifest.json", manifest)


def published(spark: SparkSession, out: str) -> dict:
    """The manifest of a whole result; :class:`Unpublished` if there is none or one is being published."""
    held = Folder(spark, out).read_json("_manifest.json")
    if not held or held["state"] != "published":
        raise Unpublished(f"{out} holds no published panel")
    return held


def read_output(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of ``OUTPUTS`` of a whole result."""
    held = published(spark, out)
    path = os.path.join(out, name)
    if name == "panel":
        return scan_panel(spark, path, fmt=held["options"]["fmt"])
    if name == "summary":
        return spark.read.option("header", True).schema(_summary_schema()).csv(path)
    return spark.read.parquet(path)


def _summary_schema() -> str:
    numbers = [f.name for f in PANEL.fields if f.name != "District"]
    return "District string, " + ", ".join(
        f"{c}_count long" if s == "count" else f"{c}_{s} double" for c in numbers for s in Q.SUMMARY_STATS)


REPORT = "section string, item string, total long, n long, pct double"


def report(spark: SparkSession, inputs: Inputs, out: str) -> DataFrame:
    """What a finished run has to say, ``(section, item, total, n, pct)``: dropped dates of each sheet, missing
    values of panel columns, districts whose station is not in the data (by variable), rows of the outputs."""
    held = published(spark, out)
    sheets = spark.createDataFrame([("dropped dates", f"{v} part {p}", n, d) for v, p, n, _, d in held["counts"]],
                                   "section string, item string, total long, n long")
    panel, summary = (read_output(spark, out, n) for n in ("panel", "summary"))
    rows = panel.agg(F.count(F.lit(1))).scalar()
    missing = read_output(spark, out, "completeness").select(F.lit("missing values").alias("section"), F.col("column").alias("item"), rows.alias("total"), F.col("missing").alias("n"))
    lost = unmatched_stations(prepare_mapping(inputs.mapping, inputs.aliases), held["stations"])
    stations = lost.groupBy("variable").agg(F.count(F.lit(1)).alias("total"), F.count_if("missing").alias("n")).select(
        F.lit("districts without station").alias("section"), F.col("variable").alias("item"), "total", "n")
    written = panel.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("Cases") > 0).alias("n")).select(
        F.lit("rows with cases").alias("section"), F.lit("panel").alias("item"), "total", "n")
    written = written.unionByName(summary.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("Cases_max") > 0).alias("n")).select(
        F.lit("rows with cases").alias("section"), F.lit("summary").alias("item"), "total", "n"))
    whole = sheets.unionByName(missing).unionByName(stations).unionByName(written)
    return whole.withColumn("pct", F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total")))


# ----------------------------------------------------------------- one more year


def append_year(spark: SparkSession, inputs: Inputs, out: str, year: int) -> None:
    """Adds (or replaces) the last year of a published Parquet panel from inputs that hold that year's data.

    Only weeks of ``year`` (first-Sunday weeks) are computed.  Lags are carried by the
    last ``max(LAG_WEEKS)`` weekly rows of each station in the years before, fills by
    each district's last panel row of the year before, and only the year's folders of
    ``weekly`` and ``panel`` are written.  Doing it again gives the same result, so a
    job that died is simply started again.  The result equals a full build, or
    :class:`NeedsFullBuild` says why it would not: other stations or districts, a gap
    before the year, later years, or (with ``align='position'``) max and min tables
    that are not level."""
    held, folder = published(spark, out), Folder(spark, out)
    options = Options(**held["options"])
    if options.fmt != "parquet" or options.lag_by != "rows":
        raise NeedsFullBuild("a year can be added to a Parquet panel with lags by rows only")
    if not folder.exists("panel", f"Year={year - 1}") or folder.exists("panel", f"Year={year + 1}"):
        raise NeedsFullBuild(f"{year} is not the year after the panel's others")
    high, low = (held["dates"].get(v) for v in ("temp_max", "temp_min"))
    if options.align == "position" and None not in (high, low) and high != low:
        raise NeedsFullBuild(f"max and min temperature have {high} and {low} dates: positions do not start level")
    previous = scan_panel(spark, folder.name("panel")).filter(F.col("Year") == year - 1)
    districts = previous.select("District").distinct()
    cases = clean_cases(inputs).filter(F.col("Year") == year)
    if not cases.join(districts, "District", "left_anti").isEmpty():
        raise NeedsFullBuild("there are cases of districts that the panel does not have")
    combined = combine_many({v: inputs.sheets[v] for v in SHEET_VARIABLES if v in inputs.sheets}, mode=options.mode,
                            per_row=inputs.per_row, infer=inputs.infer)
    if combined.stations != held["stations"]:
        raise NeedsFullBuild("the sheets' stations differ from those of the panel")

    with scratch_scope(spark) as scope:
        kept = scope.result(combined.rows.filter(week_year("date") == year), "year-rows")
        rows = Combined(kept, combined.stations)
        weekly = weekly_rollup(observations(inputs, options.align, rows), empty_sum=options.empty_sum)
        weekly = scope.result(weekly, "year-weekly")
        _write_weekly(weekly, folder.name("weekly"), dynamic=True)
        before = spark.read.schema(WEEKLY).parquet(folder.name("weekly")).filter(F.col("year") < year)
        latest = F.expr(f"slice(sort_array(collect_list(struct(year, week, value)), false), 1, {max(LAG_WEEKS)})")
        tail = before.groupBy("variable", "station").agg(F.explode(latest).alias("w")).select("variable", "station", "w.year", "w.week", "w.value")
        features = lag_features(tail.unionByName(weekly), prepare_mapping(inputs.mapping, inputs.aliases)).filter(F.col("year") == year)
        base = complete_panel(cases.unionByName(districts.select(F.lit(None).cast("int").alias("Year"), F.lit(None).cast("int").alias("Week"), "District", F.lit(None).cast("double").alias("Cases"))),
                              year, year, options.weeks)
        joined = base.join(features_wide(features), PANEL_KEYS, "left")
        last = previous.groupBy("District").agg(F.max_by(F.struct("Year", "Week", "Cases", *feature_columns()), F.struct("Year", "Week")).alias("p")).select("District", "p.*")
        filled = forward_fill(last.unionByName(joined).select(*PANEL.fieldNames()), feature_columns()).filter(F.col("Year") == year)
        panel = scope.result(filled, "year-panel")  # it reads the folder that is written next
        write_panel(panel, folder.name("panel"), dynamic=True)
    whole = scan_panel(spark, folder.name("panel"))
    write_summary(Q.district_summary(whole), folder.name("summary"))
    Q.completeness(whole).coalesce(1).write.mode("overwrite").parquet(folder.name("completeness"))
    held["fingerprint"] = f"{held['fingerprint']}+{year}"
    folder.write_json("_manifest.json", held)
