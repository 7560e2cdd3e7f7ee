"""Compare a query with its SQL twin, order aside."""

import glob
import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, list | tuple):
        return [norm(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def compare(spark, con, sf, query, sql) -> None:
    df = query(spark, sf)
    cols = sorted(df.columns)
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted([norm(x[i]) for i in at] for x in r.fetchall())
    got = sorted([norm(row[c]) for c in cols] for row in df.collect())
    assert got == want
