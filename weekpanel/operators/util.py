"""Small shared helpers: quoting, bounded row positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def qcol(name: str) -> Column:
    """Column by exact name, even with dots, spaces, brackets or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_row_position(df: DataFrame, order_col: str = "date", name: str = "pos", partition: list[str] | None = None) -> DataFrame:
    """0-based position of each row in ``order_col`` order (values unique within ``partition``).

    Distributed like ``zipWithIndex``, but inside one plan: rows are bucketed
    by calendar month; a month-size table (at most 12 rows per year and
    partition value) gets running offsets from a window; the position inside
    a bucket is a ``row_number`` partitioned by bucket.  No step holds more
    than one month of rows, and the driver receives nothing.
    """
    part = list(partition or [])
    bucket = (F.year(order_col) * 100 + F.month(order_col)).cast("int")
    tagged = df.withColumn("__bucket", bucket)
    sizes = tagged.groupBy(*part, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # ordered window over the month-size table only (bounded by the calendar)
    before = Window.partitionBy(*part).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*part, "__bucket").orderBy(order_col)
    placed = tagged.join(offsets, [*part, "__bucket"])
    pos = (F.col("__offset") + F.row_number().over(inside) - 1).cast("long")
    return placed.withColumn(name, pos).drop("__bucket", "__offset")
