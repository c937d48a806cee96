"""Daily sheets: parse, coerce, stack the parts, keep the first row per date, mean temperature.

A sheet is a wide DataFrame whose FIRST column is the time text and whose
other columns are stations (header text, units included).  Optional reserved
columns ``variable``, ``part`` and ``src_row`` are carried through; ``src_row``
is the row's position in its file and decides which duplicate date is kept.

The combine picks rows first and unpivots last.  Each sheet row becomes one
array of numbers over the stations of its variable -- NULL for every station
its part lacks, exactly what stacking the parts by column name produces.  The
date format of each sheet is chosen by an aggregate over its time column that
is joined back as a table of one row per sheet, so building the plan runs no
job.  One aggregate keeps, per ``(variable, date)``, the first row (earlier
part, then file order): ``min_by(values, (part, row))``.  It is partially
aggregated map-side, so a date repeated in a third of all rows is reduced before
the shuffle, and it sorts and shuffles sheet rows, not cells.  The mean
temperature pairs kept rows of the max and the min table, array with array, by
one aggregate; cells ``(variable, date, station, value)`` are unpivoted at the
end.  They are dense: every kept date has a cell for every station of its
variable, which later makes weekly rows dense too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weekpanel.functions.dates import DATE_TYPES, NoValidDate, format_choice, parse_chosen, parse_dates_column
from weekpanel.functions.numeric import coerce_double, sql_ident
from weekpanel.operators.clean import trim_columns
from weekpanel.operators.util import qcol, with_row_position
from weekpanel.schemas import META_COLUMNS

_INTERNAL = ("date", "_part", "_row", "_variable")
CELLS = "variable string, station string, date timestamp_ntz, value double"
ROWS = "variable string, date timestamp_ntz, values array<double>"


def station_columns(sheet: DataFrame) -> list[str]:
    """Station headers of a sheet: every column after the first, minus reserved ones."""
    return [c for c in sheet.columns[1:] if c not in META_COLUMNS and c not in _INTERNAL]


def parse_dates(sheet: DataFrame, formats: list[str] | None = None, per_row: bool = False, infer: bool = False,
                chosen: str | None = None) -> DataFrame:
    """Add ``date`` (TIMESTAMP_NTZ) parsed from the first column; keep all rows.

    The format is chosen once for the whole sheet (one small aggregate job)
    unless ``per_row`` or ``chosen`` is given.
    """
    time_col = sheet.columns[0]
    col = parse_dates_column(sheet, time_col, formats, per_row=per_row, infer=infer, chosen=chosen)
    return sheet.withColumn("date", col)


def drop_invalid_dates(sheet: DataFrame, observation=None) -> DataFrame:
    """Keep rows with a parsed ``date``.

    With a ``pyspark.sql.Observation``, the row and kept counts (``rows``,
    ``kept``) are collected as metrics of whatever action runs the plan --
    no extra job.
    """
    if observation is not None:
        sheet = sheet.observe(observation, F.count(F.lit(1)).alias("rows"), F.count("date").alias("kept"))
    return sheet.filter(F.col("date").isNotNull())


@dataclass
class Sheets:
    """Trimmed sheets in the order of the build, and each variable's stations over all its parts."""

    items: list[tuple[str, int, DataFrame]] = field(default_factory=list)
    stations: dict[str, list[str]] = field(default_factory=dict)


def list_sheets(sheets: dict[str, list[DataFrame]], trim: bool = True) -> Sheets:
    out = Sheets()
    for v, parts in sheets.items():
        for i, sheet in enumerate(parts, 1):
            sheet = trim_columns(sheet) if trim else sheet
            known = out.stations.setdefault(v, [])
            known += [c for c in station_columns(sheet) if c not in known]
            out.items.append((v, i, sheet))
    return out


def _sheet_rows(number: int, sheet: DataFrame, variable: str, part: int, stations: list[str]) -> DataFrame:
    """One sheet -> one row per sheet row: its time (as text, or typed) and a text per station of the variable."""
    time_col = sheet.columns[0]
    types = {f.name: f.dataType for f in sheet.schema.fields}
    own = set(station_columns(sheet))
    row = "src_row" if "src_row" in sheet.columns else "monotonically_increasing_id()"
    values = ", ".join(f"CAST({sql_ident(s)} AS STRING)" if s in own else "NULL" for s in stations)
    typed = isinstance(types[time_col], DATE_TYPES)
    time = sql_ident(time_col)
    return sheet.selectExpr(
        f"{number} AS _sheet", f"'{variable}' AS variable", f"{part} AS part", f"{row} AS src_row",
        f"CAST({time} AS STRING) AS time_text",
        f"CAST({time if typed else 'NULL'} AS TIMESTAMP_NTZ) AS typed", f"CAST(array({values}) AS ARRAY<STRING>) AS texts",
    )


def dated_rows(sheets: Sheets, formats: list[str] | None = None, per_row: bool = False, infer: bool = False) -> DataFrame:
    """All rows of all sheets, ``(_sheet, variable, part, src_row, time_text, date, values)``.

    ``date`` is NULL where the format chosen for the sheet does not fit the row;
    see :func:`weekpanel.functions.dates.format_choice` for the options.  Cells become
    numbers by one expression over the row's array, however many stations there are."""
    rows = None
    for number, (v, p, sheet) in enumerate(sheets.items):
        one = _sheet_rows(number, sheet, v, p, sheets.stations[v])
        rows = one if rows is None else rows.unionByName(one)
    choice = F.lit(None).cast("int")
    if not per_row:
        chosen = format_choice(rows.filter("typed IS NULL"), "_sheet", "time_text", formats, infer)
        rows = rows.join(F.broadcast(chosen), "_sheet", "left")  # one row per sheet
        choice = F.col("choice")
    date = F.coalesce("typed", parse_chosen("time_text", choice, formats, per_row, infer))
    values = F.transform("texts", coerce_double)
    return rows.select("_sheet", "variable", "part", "src_row", "time_text", date.alias("date"), values.alias("values"))


def first_rows(rows: DataFrame) -> DataFrame:
    """The first row of each date, ``(variable, date, part, src_row, values)``: earlier part, then file order."""
    place = F.struct("part", "src_row")
    kept = rows.filter("date IS NOT NULL").groupBy("variable", "date").agg(
        F.min(place).alias("place"), F.min_by("values", place).alias("values"))
    return kept.select("variable", "date", F.col("place.part").alias("part"), F.col("place.src_row").alias("src_row"), "values")


def first_values(rows: DataFrame) -> DataFrame:
    """Per date and station the first non-missing value, ``(variable, date, values)``: earlier part, then file order."""
    cells = rows.filter("date IS NOT NULL").select("variable", "date", "part", "src_row", F.posexplode("values").alias("i", "value"))
    rank = F.struct(F.col("value").isNull(), "part", "src_row")
    first = cells.groupBy("variable", "date", "i").agg(F.min_by("value", rank).alias("value"))
    listed = first.groupBy("variable", "date").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("l"))
    return listed.select("variable", "date", F.transform("l", lambda x: x["value"]).alias("values"))


def unpivot_rows(rows: DataFrame, stations: dict[str, list[str]]) -> DataFrame:
    """Kept rows -> cells ``(variable, station, date, value)``."""
    named = {v: names for v, names in stations.items() if names}
    if not named:
        return rows.sparkSession.createDataFrame([], CELLS)
    names = F.create_map(*[x for v, n in named.items() for x in (F.lit(v), F.array(*[F.lit(s) for s in n]))])
    cells = rows.select("variable", "date", F.explode(F.arrays_zip(F.element_at(names, F.col("variable")).alias("station"), "values")).alias("c"))
    return cells.select("variable", F.col("c.station").alias("station"), "date", F.col("c.values").alias("value"))


@dataclass
class Combined:
    """Kept rows of every variable, plus each variable's stations.

    ``rows``: ``(variable, date, values)``, a number per station of the variable.
    ``counts`` is known once an action has computed ``rows``, if an observation was asked for."""

    rows: DataFrame
    stations: dict[str, list[str]]
    sheets: list[tuple[str, int]] = field(default_factory=list)
    observation: Observation | None = None

    @property
    def cells(self) -> DataFrame:
        return unpivot_rows(self.rows, self.stations)

    def long(self, variables: list[str] | None = None) -> DataFrame:
        if variables is None:
            return self.cells
        return unpivot_rows(self.rows.filter(F.col("variable").isin(variables)), {v: self.stations[v] for v in variables if v in self.stations})

    def wide(self, variable: str) -> DataFrame:
        """``date, <stations>`` of one variable: a projection of its rows."""
        one = self.rows.filter(F.col("variable") == variable)
        return one.select("date", *[F.get("values", F.lit(i)).alias(s) for i, s in enumerate(self.stations[variable])])

    def counts(self) -> list[tuple[str, int, int, int, int]]:
        """``(variable, part, rows, kept, dropped)`` per sheet, as observed while the rows were written.

        A task that runs twice because an executor was lost may be counted twice."""
        if self.observation is None:
            raise ValueError("no observation was asked for")
        seen = self.observation.get
        return [(v, p, seen[f"rows_{i}"], seen[f"kept_{i}"], seen[f"rows_{i}"] - seen[f"kept_{i}"]) for i, (v, p) in enumerate(self.sheets)]

    def check_dates(self) -> None:
        """Raises :class:`NoValidDate` for a sheet with rows and no valid date."""
        for v, p, rows, kept, _ in self.counts():
            if rows and not kept:
                raise NoValidDate(f"{v}, part {p}: none of {rows} times fits a known format")


def combine_many(sheets: dict[str, list[DataFrame]], trim: bool = True, formats: list[str] | None = None,
                 mode: str = "first_row", per_row: bool = False, infer: bool = False,
                 observation: Observation | None = None) -> Combined:
    """Combine the parts of every variable in one plan; no job runs here.

    parse -> drop invalid dates -> coerce -> keep the first row per
    (variable, date) -> rows over the union of the parts' columns.
    With an ``observation`` the rows and kept rows of every sheet are counted by
    whatever action computes the result, without a job of their own.

    ``mode='first_row'`` (the original behaviour): the whole first row of a
    date wins, so on a date present in several parts, stations that only a
    later part has become NULL.  ``mode='coalesce'``: each station takes its
    first non-missing value over the rows of that date (earlier part first).
    """
    if mode not in ("first_row", "coalesce"):
        raise ValueError(f"mode must be 'first_row' or 'coalesce', not {mode!r}")
    listed = list_sheets(sheets, trim)
    listed.items = [(v, p, s) for v, p, s in listed.items if listed.stations[v]]
    if not listed.items:
        spark = next((s.sparkSession for parts in sheets.values() for s in parts), None)
        return Combined(spark.createDataFrame([], ROWS), listed.stations)
    rows = dated_rows(listed, formats, per_row, infer)
    if observation is not None:
        of = [(F.col("_sheet") == i, i) for i in range(len(listed.items))]
        rows = rows.observe(observation, *[F.count_if(own).alias(f"rows_{i}") for own, i in of],
                            *[F.count_if(own & F.col("date").isNotNull()).alias(f"kept_{i}") for own, i in of])
    kept = (first_rows if mode == "first_row" else first_values)(rows).select("variable", "date", "values")
    return Combined(kept, listed.stations, [(v, p) for v, p, _ in listed.items], observation)


def combine_parts(*sheets: DataFrame, trim: bool = True, formats: list[str] | None = None,
                  mode: str = "first_row") -> DataFrame:
    """One variable's parts -> wide ``date, <stations...>`` (see :func:`combine_many`)."""
    return combine_many({"_": list(sheets)}, trim=trim, formats=formats, mode=mode).wide("_")


def mean_rows(rows: DataFrame, max_stations: list[str], min_stations: list[str], align: str = "position",
              either: bool = False) -> DataFrame:
    """Mean temperature of kept rows: ``(variable='temp', date, values)`` over the max table's stations and dates.

    ``align='position'`` pairs the i-th date of the max table with the i-th of the
    min table, both in date order, as a zip of two sorted tables does;
    ``align='date'`` pairs equal dates.  One conditional aggregate brings the two
    arrays of a pair together.  A station that the min table lacks takes the max
    value; a missing value on either side gives a missing mean, or with ``either``
    the value of the other side."""
    low = F.col("variable") == "temp_min"
    two = rows.filter(F.col("variable").isin("temp_max", "temp_min")).select(low.alias("__low"), "date", "values")
    if align == "position":
        keyed = with_row_position(two, "date", "__key", partition=["__low"])
    elif align == "date":
        keyed = two.withColumn("__key", F.col("date"))
    else:
        raise ValueError(f"align must be 'position' or 'date', not {align!r}")
    paired = keyed.groupBy("__key").agg(
        F.max(F.when(~F.col("__low"), F.struct("date", "values"))).alias("hi"),
        F.max(F.when(F.col("__low"), F.col("values"))).alias("lo"),
    ).filter("hi IS NOT NULL")
    place = {s: i for i, s in enumerate(min_stations)}
    at = F.array(*[F.lit(place.get(s)).cast("int") for s in max_stations])

    def mean(x, i):
        y = F.get("lo", i)
        both = (x + y) / 2
        return F.when(i.isNull(), x).otherwise(F.coalesce(both, x, y) if either else both)

    return paired.select(F.lit("temp").alias("variable"), F.col("hi.date").alias("date"), F.zip_with("hi.values", at, mean).alias("values"))


def mean_temperature(tmax: DataFrame, tmin: DataFrame, align: str = "position", either: bool = False) -> DataFrame:
    """:func:`mean_rows` on wide tables: ``date, <stations of tmax>``."""
    def packed(wide: DataFrame, variable: str) -> tuple[DataFrame, list[str]]:
        stations = [c for c in wide.columns if c != "date"]
        values = F.array(*[qcol(c).cast("double") for c in stations]) if stations else F.array().cast("array<double>")
        return wide.select(F.lit(variable).alias("variable"), "date", values.alias("values")), stations

    high, stations = packed(tmax, "temp_max")
    low, min_stations = packed(tmin, "temp_min")
    if not stations:
        return tmax.select("date")
    return Combined(mean_rows(high.unionByName(low), stations, min_stations, align, either), {"temp": stations}).wide("temp")


def to_long(wide: DataFrame, variable: str) -> DataFrame:
    """Wide daily table -> ``(variable, station, date, value)``; NULL cells are kept."""
    stations = [c for c in wide.columns if c != "date"]
    if not stations:
        return wide.sparkSession.createDataFrame([], CELLS)
    long = wide.unpivot(["date"], [qcol(s) for s in stations], "station", "value")
    return long.select(F.lit(variable).alias("variable"), "station", "date", F.col("value").cast("double").alias("value"))

