"""Numeric coercion and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plain decimal numbers with optional sign, fraction and exponent, optionally
# padded with whitespace.  Anything else ('-', 'Trace', '1,000', '0x10', '1d',
# 'inf', 'nan', blanks) becomes NULL.  The guard is needed because Spark's own
# cast accepts Java float suffixes like '1d' and '2f'.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def coerce_double(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Cell value -> DOUBLE, bad values -> NULL, NaN -> NULL.

    ``dtype`` is the input column's type when known: numeric inputs skip the
    text guard.
    """
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and isinstance(dtype, T.NumericType):
        num = col.cast("double")
    else:
        txt = col.cast("string")
        num = F.when(txt.rlike(NUMBER_PATTERN), F.trim(txt).try_cast("double"))
    return F.nanvl(num, F.lit(None).cast("double"))


def sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def stable_sum(c: Column | str, scale: int | None = 6) -> Column:
    """A sum that does not depend on the order of rows: values are added as decimals with ``scale`` places.

    Values with more places are rounded to ``scale`` first.  Groups with a value
    or sum that no such decimal holds, and ``scale=None``, are summed as doubles."""
    col = F.col(c) if isinstance(c, str) else c
    if scale is None:
        return F.sum(col)
    exact = col.try_cast(T.DecimalType(28, scale))
    whole = F.count(exact) == F.count(col)
    return F.coalesce(F.when(whole, F.try_sum(exact)).cast("double"), F.sum(col))


def stable_mean(c: Column | str, scale: int | None = 6) -> Column:
    """The mean of the values present, from :func:`stable_sum`; NULL without any."""
    col = F.col(c) if isinstance(c, str) else c
    return F.avg(col) if scale is None else stable_sum(col, scale) / F.nullif(F.count(col), F.lit(0))


def rint2(c: Column | str) -> Column:
    """Round half-to-even on the binary value to 2 decimals, like numpy's ``round(x, 2)``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.rint(col * 100) / 100
