"""Column-level building blocks (``Column -> Column``), all native Spark expressions."""

from weekpanel.functions.calendar import calendar_trace, week_number, week_start, week_year, with_week
from weekpanel.functions.dates import choose_format, format_choice, parse_chosen, parse_dates_column
from weekpanel.functions.numeric import coerce_double, rint2
from weekpanel.functions.text import (
    extract_period_week,
    extract_period_year,
    normalize_code,
    standardize_name,
    strip_ws,
    title_case,
)

__all__ = [
    "calendar_trace",
    "choose_format",
    "coerce_double",
    "extract_period_week",
    "extract_period_year",
    "normalize_code",
    "parse_dates_column",
    "rint2",
    "format_choice",
    "parse_chosen",
    "standardize_name",
    "strip_ws",
    "title_case",
    "week_number",
    "week_start",
    "week_year",
    "with_week",
]
