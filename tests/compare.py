"""Compare a Spark result with the DuckDB result of the equivalent SQL."""

from __future__ import annotations

import math

import duckdb

from newsiq.catalog.tables import BASE


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(dtype: str) -> str:
    d = dtype.lower()
    if d in ("bigint", "hugeint", "int", "integer", "smallint", "tinyint", "ubigint"):
        return {"bigint": "i64"}.get(d, "i32" if d in ("int", "integer") else d)
    if d in ("string", "varchar"):
        return "str"
    if d in ("timestamp", "timestamp_ntz"):
        return "ts"
    return d


def _value(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def diff(spark_df, con, sql: str) -> str | None:
    """None when rows, names, types and values agree, else what differs."""
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    right = res.fetchall()
    types = dict(zip(names, [str(t[1]) for t in con.execute(f"DESCRIBE {sql}").fetchall()]))
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    bad = [
        (c, t, types[c]) for c, t in spark_df.dtypes if kind(t) != kind(types[c])
    ]
    if bad:
        return f"types {bad}"
    order = sorted(names)
    left = sorted(tuple(_value(r[c]) for c in order) for r in spark_df.collect())
    idx = [names.index(c) for c in order]
    right = sorted(tuple(_value(r[i]) for i in idx) for r in right)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}; first left {left[:2]} right {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"values ({order}) {[(c, x, y) for c, x, y in zip(order, a, b) if x != y][:4]} in {sum(x != y for x, y in zip(left, right))} rows"
    return None
