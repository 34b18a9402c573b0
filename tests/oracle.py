"""Comparing a query's result with its SQL on the same parquet files."""

import glob
import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(int(value)))
    if isinstance(value, float) and math.isnan(value):
        return (2, "nan")
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return (2, repr(float(value)))
    return (3, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """None when equal, else what differs."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} / {len(want[1])}; only here {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return None
