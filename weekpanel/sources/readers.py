"""Readers with explicit schemas (no inference on large inputs).

CSV rows that do not have as many cells as the header are not lost unseen.  Short
rows stay, their last cells NULL, as the original's reader has them.  Long rows are
left out, since it cannot be told which cell is the extra one; with
``malformed='fail'`` any such row stops the action that meets it.  Both kinds are in
:func:`malformed_rows`, to be counted or written to a quarantine folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from weekpanel.functions.numeric import coerce_double
from weekpanel.operators.util import qcol
from weekpanel.schemas import CASES, MAPPING, PANEL


# Text that pandas' CSV reader treats as missing by default (its documented
# ``na_values`` list); applied to text columns of the case table for parity.
PANDAS_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


class MissingInput(FileNotFoundError):
    """A required input path does not exist (reported without a JVM trace)."""


class MissingColumn(ValueError):
    """A file's header lacks a required column."""


def _by_name(raw: DataFrame, path: str, required: list[str]) -> dict[str, F.Column]:
    """The required columns of a table read as text, found by header name (outer
    blanks ignored); other columns and their order do not matter."""
    found = {}
    for c in raw.columns:
        found.setdefault(c.strip(), qcol(c))
    absent = [c for c in required if c not in found]
    if absent:
        raise MissingColumn(f"{path}: no column {', '.join(absent)} (header: {', '.join(raw.columns)})")
    return {c: found[c] for c in required}


_RECORD = "_weekpanel_malformed_record"


def _landed(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A CSV file as text, with the whole record in ``_RECORD`` where the number of cells is not the header's.

    Spark tells such rows only if it parses whole rows, hence no column pruning."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _RECORD]])
    reader = spark.read.option("header", True).option("columnNameOfCorruptRecord", _RECORD).option("columnPruning", False)
    raw = reader.schema(schema).csv(path)
    # always true, but names a column beside the record: Spark refuses to read the record alone
    return (raw.filter(F.length(F.concat_ws("", qcol(header[0]))) >= 0) if header else raw), header


def _is_long(header: list[str]) -> F.Column:
    """Whether a malformed record has more cells than the header: a mark appended as one more cell is not among its first ones."""
    cells = F.from_csv(F.concat(F.col(_RECORD), F.lit(",\x02")), ", ".join(f"c{i} string" for i in range(len(header))))
    marked = F.exists(F.array(*[cells[f"c{i}"] for i in range(len(header))]), lambda c: F.coalesce(c.endswith("\x02"), F.lit(False)))
    return F.col(_RECORD).isNotNull() & ~marked


def _text_csv(spark: SparkSession, path: str, malformed: str = "quarantine") -> DataFrame:
    raw, header = _landed(spark, path)
    if malformed == "fail":
        message = F.concat(F.lit(f"{path}: a row has not {len(header)} cells: "), F.col(_RECORD))
        keep = F.when(F.col(_RECORD).isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
    elif malformed == "quarantine":
        keep = ~_is_long(header)
    else:
        raise ValueError(f"malformed must be 'quarantine' or 'fail', not {malformed!r}")
    return raw.filter(keep).drop(_RECORD)


def _typed(column: F.Column, kind: T.DataType) -> F.Column:
    """Text -> the model's type.  Whole numbers written as ``2020.0`` are integers;
    what does not parse is NULL."""
    if isinstance(kind, T.StringType):
        return column
    number = coerce_double(column)
    if isinstance(kind, T.DoubleType):
        return number
    return F.when(number == F.floor(number), number).try_cast(kind)


def _guard(read):
    def wrapped(spark: SparkSession, path: str, *a, **k):
        try:
            return read(spark, path, *a, **k)
        except AnalysisException as e:  # PATH_NOT_FOUND and friends
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                raise MissingInput(f"input not found: {path}") from None
            raise

    wrapped.__doc__ = read.__doc__
    wrapped.__name__ = read.__name__
    return wrapped


def file_order() -> F.Column:
    """Orderable key that follows file order across splits: (file, split start, row in split)."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


@_guard
def malformed_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(file, kind, record)`` of the rows of a CSV input whose cells are fewer (``short``) or more (``long``) than the header's."""
    raw, header = _landed(spark, path)
    kind = F.when(_is_long(header), "long").otherwise("short")
    return raw.filter(F.col(_RECORD).isNotNull()).select(F.col("_metadata.file_path").alias("file"), kind.alias("kind"), F.col(_RECORD).alias("record"))


@_guard
def scan_cases(spark: SparkSession, path: str, pandas_na: bool = True, malformed: str = "quarantine") -> DataFrame:
    """Long case CSV ``Year, Week, District, Cases`` with header.

    Columns are found by name; other columns are ignored and an absent one
    raises :class:`MissingColumn`.  Unparsable numbers and ``NaN`` become NULL,
    ``2020.0`` is the integer 2020.  With ``pandas_na`` the district text tokens
    pandas reads as missing (``NA``, ``null``, ...) are NULL as well.
    """
    raw = _text_csv(spark, path, malformed)
    cols = _by_name(raw, path, CASES.fieldNames())
    if pandas_na:
        cols["District"] = F.when(cols["District"].isin(PANDAS_NA_TOKENS), F.lit(None).cast("string")).otherwise(cols["District"])
    return raw.select(*[_typed(cols[f.name], f.dataType).alias(f.name) for f in CASES.fields])


@_guard
def scan_cases_wide(spark: SparkSession, path: str, id_col: str = "period", malformed: str = "quarantine") -> DataFrame:
    """Wide case CSV: ``period`` text + one column per district, cells -> DOUBLE."""
    raw = _text_csv(spark, path, malformed)
    if id_col not in raw.columns:
        raise MissingColumn(f"{path}: no column {id_col} (header: {', '.join(raw.columns)})")
    return raw.select(qcol(id_col), *[coerce_double(qcol(c)).alias(c) for c in raw.columns if c != id_col])


@_guard
def scan_daily_wide(spark: SparkSession, path: str, fmt: str = "csv", malformed: str = "quarantine") -> DataFrame:
    """A landed daily sheet plus ``src_row`` in file order.

    CSV (header): every column as text, header text kept exactly.  Parquet:
    columns keep their types (a typed time column passes through the date
    parsing, numeric cells skip the text guard).
    """
    if fmt == "parquet":
        return spark.read.parquet(path).select("*", file_order().alias("src_row"))
    raw = _text_csv(spark, path, malformed)
    return raw.select("*", file_order().alias("src_row"))


@_guard
def scan_mapping(spark: SparkSession, path: str, pandas_na: bool = True, malformed: str = "quarantine") -> DataFrame:
    """Station mapping CSV with header (columns found by name), plus ``src_row`` in file order.

    With ``pandas_na`` the text tokens pandas reads as missing are NULL (a
    station cell ``NA`` is a missing station, not a station named NA).
    """
    raw = _text_csv(spark, path, malformed)
    cols = [
        (F.when(c.isin(PANDAS_NA_TOKENS), F.lit(None).cast("string")).otherwise(c) if pandas_na else c).alias(name)
        for name, c in _by_name(raw, path, MAPPING.fieldNames()).items()
    ]
    return raw.select(*cols, file_order().alias("src_row"))


@_guard
def scan_panel(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A written panel (parquet partitioned by Year, or CSV with header)."""
    if fmt == "csv":
        raw = _text_csv(spark, path)
        cols = _by_name(raw, path, PANEL.fieldNames())
        return raw.select(*[_typed(cols[f.name], f.dataType).alias(f.name) for f in PANEL.fields])
    df = spark.read.parquet(path)
    absent = [c for c in PANEL.fieldNames() if c not in df.columns]
    if absent:
        raise MissingColumn(f"{path}: no column {', '.join(absent)}")
    return df.select(*PANEL.fieldNames())
