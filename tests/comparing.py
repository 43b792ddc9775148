"""Runs a query and its SQL on the same tables and compares the rows."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def cell(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, float):
        return ("n", "nan" if math.isnan(v) else f"{v:.6f}")
    if isinstance(v, int):
        return ("n", f"{v:.6f}")
    if isinstance(v, (list, tuple)):
        return ("l", str([cell(x) for x in v]))
    return ("s", str(v))


def rows_of(rows):
    return sorted(tuple(cell(v) for v in r) for r in rows)


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def agree(spark, name, query, sql, folder):
    got = query(spark, folder)
    columns = sorted(got.columns)
    mine = rows_of(got.select(*columns).collect())
    theirs = rows_of(connect(folder).sql(f"select {', '.join(columns)} from ({sql})").fetchall())
    assert mine == theirs, f"{name}: {len(mine)} and {len(theirs)} rows"
    return len(mine)
