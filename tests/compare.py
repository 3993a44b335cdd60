"""Runs a query and its SQL oracle over the same tables and compares the rows without order."""

import glob
import math
import os

import duckdb


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, found.fetchall()


def norm(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        value = float(value)
        return f"{value:.6f}" if not math.isnan(value) else "nan"
    return f"{float(value):.6f}" if isinstance(value, int) else str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def assert_same(df, sql, sf_dir):
    names, rows = oracle_rows(sql, sf_dir)
    want_names, want = table(names, rows)
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got_names == want_names
    assert len(got) == len(want)
    assert got == want
