"""The full panel build: cases + daily sheets + mapping -> panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation

from weekpanel.operators.clean import standardize_names
from weekpanel.operators.combine import Combined, combine_many, mean_rows, unpivot_rows
from weekpanel.operators.features import lag_features, prepare_mapping
from weekpanel.operators.panel import complete_panel, integrate_panel, year_range
from weekpanel.operators.rollup import merge_districts, weekly_rollup

# Variables read from sheets; ``temp`` is derived from max and min.
SHEET_VARIABLES = ["temp_max", "temp_min", "humidity", "precipitation"]


@dataclass
class Inputs:
    """Everything the panel build reads.

    ``cases_raw``: ``(Year, Week, District, Cases)`` as delivered (names not
    cleaned).  ``sheets``: variable -> list of wide daily sheets, in part
    order.  ``mapping``: station mapping with ``src_row``.  The last three say
    how dates of sheets are read.
    """

    cases_raw: DataFrame
    sheets: dict[str, list[DataFrame]]
    mapping: DataFrame
    aliases: dict[str, str] | None = None
    per_row: bool = False  # every row of a sheet tries all date formats
    infer: bool = False  # a sheet that no format fits tries day-first fallbacks
    strict: bool = False  # a sheet without any valid date is an error
    either: bool = False  # a mean temperature with one missing side takes the other


def clean_cases(inputs: Inputs) -> DataFrame:
    return merge_districts(standardize_names(inputs.cases_raw, "District", inputs.aliases))


def base_panel(inputs: Inputs, weeks: int | str = 52) -> DataFrame:
    """Spine over the raw year range x 52 weeks x districts, with cases (0 when missing)."""
    return complete_panel(clean_cases(inputs), *year_range(inputs.cases_raw), weeks)


def combine_inputs(inputs: Inputs, hold: str = "write", mode: str = "first_row") -> Combined:
    """All sheets combined by one aggregate.

    The kept rows (a row per date and variable) are read by the weekly rollup of
    every variable and by the mean temperature.  ``hold='write'`` writes them once
    under the scratch folder, counting rows and dropped dates of each sheet on the
    way (``Combined.counts``), and checks ``strict``; ``'cache'`` keeps them in memory
    and disk of the executors when a later action first needs them (no job runs
    here); ``'none'`` leaves them lazy."""
    from weekpanel.session import materialize

    unknown = sorted(set(inputs.sheets) - set(SHEET_VARIABLES))
    if unknown:
        raise ValueError(f"unknown sheet variable {', '.join(unknown)}; known: {', '.join(SHEET_VARIABLES)}")
    observation = Observation() if hold == "write" else None
    c = combine_many({v: inputs.sheets[v] for v in SHEET_VARIABLES if v in inputs.sheets}, mode=mode,
                     per_row=inputs.per_row, infer=inputs.infer, observation=observation)
    if hold == "none" or not c.sheets:
        return c
    if hold == "cache":
        return Combined(c.rows.persist(), c.stations, c.sheets)
    c = Combined(materialize(c.rows, "combined"), c.stations, c.sheets, observation)
    if inputs.strict:
        c.check_dates()
    return c


def mean_of(c: Combined, align: str = "position", either: bool = False) -> Combined | None:
    """Mean temperature rows of the combined sheets (variable ``temp``)."""
    if not (c.stations.get("temp_max") and "temp_min" in c.stations):
        return None
    rows = mean_rows(c.rows, c.stations["temp_max"], c.stations["temp_min"], align, either)
    return Combined(rows, {"temp": c.stations["temp_max"]})


def observations(inputs: Inputs, align: str = "position", combined: Combined | None = None) -> DataFrame:
    """All variables as one long daily table ``(variable, station, date, value)``."""
    c = combined or combine_inputs(inputs)
    mean = mean_of(c, align, inputs.either)
    if mean is None:
        return c.cells
    return unpivot_rows(c.rows.unionByName(mean.rows), {**c.stations, **mean.stations})


def weekly(inputs: Inputs, align: str = "position", mode: str = "first_row", empty_sum: str = "zero",
           combined: Combined | None = None) -> DataFrame:
    return weekly_rollup(observations(inputs, align, combined or combine_inputs(inputs, mode=mode)), empty_sum=empty_sum)


def features(inputs: Inputs, align: str = "position", mode: str = "first_row", empty_sum: str = "zero",
             lag_by: str = "rows") -> DataFrame:
    return lag_features(weekly(inputs, align, mode, empty_sum), prepare_mapping(inputs.mapping, inputs.aliases), by=lag_by)


def build_panel(inputs: Inputs, align: str = "position", mode: str = "first_row", empty_sum: str = "zero",
                lag_by: str = "rows", weeks: int | str = 52) -> DataFrame:
    """The panel: 4 key/target columns + 25 features, forward filled per district.

    Defaults reproduce the original semantics; the options are the
    documented alternatives: ``align='date'`` (pair max/min by date),
    ``mode='coalesce'`` (first non-missing value per station across parts),
    ``empty_sum='null'`` (all-missing weekly sums stay missing),
    ``lag_by='calendar'`` (lags in calendar weeks), ``weeks='calendar'``
    (spine with week 53 where the calendar has one).
    """
    return integrate_panel(base_panel(inputs, weeks), features(inputs, align, mode, empty_sum, lag_by))


def ordered(panel: DataFrame) -> DataFrame:
    """Output order (District, Year, Week); use only right before showing or writing."""
    return panel.orderBy("District", "Year", "Week")


__all__ = ["Inputs", "build_panel", "base_panel", "clean_cases", "combine_inputs", "mean_of", "observations",
           "weekly", "features", "ordered"]
