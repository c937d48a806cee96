"""Date parsing for daily sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpanel.schemas import DATE_FORMATS

# Day-first fallbacks used only when asked (``infer=True``).
DAYFIRST_FALLBACKS = ["d/M/yyyy H:m", "d-M-yyyy H:m:s", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d H:m:s", "yyyy-M-d"]


DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


class NoValidDate(ValueError):
    """A sheet has rows, and not one of their times can be parsed."""


def format_choice(times: DataFrame, sheet: str, time: str, formats: list[str] | None = None, infer: bool = False) -> DataFrame:
    """``(sheet, choice)``: for each sheet the number of the first format that parses any of its times.

    One aggregate, a row per sheet, to be joined to the rows; nothing runs here.
    A sheet that no format fits has a NULL choice, or with ``infer`` the number
    that stands for the day-first fallbacks (each row then tries them in order)."""
    formats = list(formats or DATE_FORMATS)
    fits = [F.when(F.count(parse_with(time, f)) > 0, F.lit(i)) for i, f in enumerate(formats)]
    return times.groupBy(sheet).agg(F.coalesce(*fits, F.lit(len(formats) if infer else None)).cast("int").alias("choice"))


def parse_chosen(time: str, choice: Column, formats: list[str] | None = None, per_row: bool = False, infer: bool = False) -> Column:
    """The parsed time of a row by its sheet's choice; with ``per_row`` the first format that fits the row."""
    formats = list(formats or DATE_FORMATS)
    tried = [parse_with(time, f) for f in formats]
    fallbacks = F.coalesce(*[parse_with(time, f) for f in DAYFIRST_FALLBACKS])
    if per_row:
        return F.coalesce(*tried, *([fallbacks] if infer else []))
    out = F.when(choice == len(formats), fallbacks)
    for i, one in enumerate(tried):
        out = out.when(choice == i, one)
    return out


def parse_with(c: Column | str, fmt: str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(col.cast("string"), F.lit(fmt)).cast(T.TimestampNTZType())


def choose_format(df: DataFrame, col: str, formats: list[str] | None = None) -> str | None:
    """The first format that parses at least one row of ``df[col]``.

    Runs ONE aggregate job (a count per format, partially aggregated), and
    returns a format string to the driver -- never rows.
    """
    formats = formats or DATE_FORMATS
    counts = df.agg(*[F.count(parse_with(col, f)).alias(f"n{i}") for i, f in enumerate(formats)]).first()
    for i, f in enumerate(formats):
        if counts[f"n{i}"] > 0:
            return f
    return None


def parse_dates_column(
    df: DataFrame,
    col: str,
    formats: list[str] | None = None,
    per_row: bool = False,
    infer: bool = False,
    chosen: str | None = None,
) -> Column:
    """Expression for the parsed timestamp of ``df[col]``.

    Already typed dates/timestamps pass through.  Text: with ``per_row`` each
    row tries the formats in order (``coalesce``); otherwise one format is
    chosen for the whole table (:func:`choose_format`) and rows in any other
    format become NULL (pass ``chosen`` when it is already known).  ``infer`` adds day-first fallbacks when no listed
    format matches anything.
    """
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(col).cast(T.TimestampNTZType())
    formats = list(formats or DATE_FORMATS)
    if per_row:
        return F.coalesce(*[parse_with(col, f) for f in formats + (DAYFIRST_FALLBACKS if infer else [])])
    chosen = chosen or choose_format(df, col, formats)
    if chosen is None and infer:
        return F.coalesce(*[parse_with(col, f) for f in DAYFIRST_FALLBACKS])
    if chosen is None:
        return F.lit(None).cast(T.TimestampNTZType())
    return parse_with(col, chosen)
