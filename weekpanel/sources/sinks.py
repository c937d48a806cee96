"""Writers.  Paths are arguments; nothing is written to a machine-local default."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Keep cell text exactly (Spark's CSV writer trims by default).
CSV_WRITE = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_panel(panel: DataFrame, path: str, fmt: str = "parquet", dynamic: bool = False) -> None:
    """Panel output.  Parquet is partitioned by ``Year`` (readers prune years)
    and sorted within files by district and week; CSV keeps a header.  With
    ``dynamic`` only the folders of the years in ``panel`` are replaced."""
    ordered = panel.sortWithinPartitions("District", "Year", "Week")
    if fmt == "csv":
        ordered.write.mode("overwrite").options(**CSV_WRITE).csv(path)
    else:
        writer = panel.sortWithinPartitions("Year", "District", "Week").write.mode("overwrite").partitionBy("Year")
        (writer.option("partitionOverwriteMode", "dynamic") if dynamic else writer).parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Per-district summary as CSV; the two-row header (column, statistic) is
    flattened to ``{column}_{statistic}``."""
    summary.write.mode("overwrite").options(**CSV_WRITE).csv(path)


def write_cases_long(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").options(**CSV_WRITE).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_WRITE).csv(path)
