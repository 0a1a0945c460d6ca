"""Compares a query with its SQL, as sorted rows."""

import glob
import os


def connection(folder):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted([tuple(repr(r[k]) for k in order) for r in rows])


def differs(spark, con, run, sql, folder):
    """None, or what differs."""
    df = run(spark, folder)
    mine = table(df.columns, df.collect())
    result = con.sql(sql)
    theirs = table(list(result.columns), result.fetchall())
    if mine != theirs:
        a, b = set(mine[1]), set(theirs[1])
        return mine[0], theirs[0], len(mine[1]), len(theirs[1]), sorted(a - b)[:2], sorted(b - a)[:2]
    return None
