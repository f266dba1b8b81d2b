"""Rows of Spark and of DuckDB made comparable."""

import glob
import math
import os
from collections import Counter


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows(df, *cols):
    cols = cols or tuple(sorted(df.columns))
    return Counter(repr(tuple(norm(x) for x in r)) for r in df.select(*cols).collect())


def duck(d):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(repr(tuple(norm(row[i]) for i in order)) for row in r.fetchall())
