"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Used by the tests and by ``tools``; mirrors the driver's gate: same row
count, same column names, same order-insensitive values.
"""

from __future__ import annotations

import math

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if digits >= 17 else round(v, digits)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    if hasattr(v, "isoformat"):
        return str(v)[:19].replace("T", " ")
    return v


def _rows(pdf, digits):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x, digits) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_mismatches(spark_df, con, sql: str) -> dict:
    """Columns whose Spark type and DuckDB type differ (simple types only)."""
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema.fields}
    dt = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    return {k: (v, dt.get(k)) for k, v in st.items() if v != dt.get(k)}


def compare(spark_df, con, sql: str, digits: int = 9) -> dict:
    import pandas as pd

    types = type_mismatches(spark_df, con, sql)
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    d = d.astype(object).where(pd.notna(d), None)
    s = s.astype(object).where(pd.notna(s), None)
    res = {"spark_rows": len(s), "oracle_rows": len(d)}
    res["rows"] = len(s) == len(d)
    res["schema"] = sorted(s.columns) == sorted(d.columns)
    res["types"] = not types
    if types:
        res["type_mismatches"] = types
    if not res["schema"]:
        res["spark_cols"], res["oracle_cols"] = sorted(s.columns), sorted(d.columns)
        res["values"] = False
        return res
    _, rs = _rows(s, digits)
    _, rd = _rows(d, digits)
    res["values"] = rs == rd
    if not res["values"]:
        ss, dd = set(rs), set(rd)
        res["only_spark"] = sorted(ss - dd, key=str)[:3]
        res["only_oracle"] = sorted(dd - ss, key=str)[:3]
    return res
