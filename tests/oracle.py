"""Run queries next to their SQL in DuckDB and compare. Usage: oracle.py <sf_dir> [name ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if v != v else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted([[plain(r[i]) for i in order] for r in rows], key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want_cols, want = rows_of(cols, res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        a, b = {repr(r) for r in got}, {repr(r) for r in want}
        return f"rows {len(got)} != {len(want)}; extra {sorted(a - b)[:2]} missing {sorted(b - a)[:2]}", len(got)
    for g, w in zip(got, want, strict=True):
        if repr(g) != repr(w):
            same = all(
                x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-9) for x, y in zip(g, w, strict=True)
            )
            return f"{'CLOSE ' if same else ''}row {got_cols} {g} != {w}", len(got)
    return None, len(got)


def connect(sf_dir):
    import duckdb

    from sigspark.session import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main():
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    from sigspark.session import build_session

    spark = build_session("local[8]", **{"spark.sigspark.maxGroupRows": os.environ.get("GROUP_ROWS", "2000000"), "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sqls:
                err, n = compare(spark, con, name, fn, sqls[name], sf_dir)
            else:
                err, n = None, fn(spark, sf_dir).count()
                name += " (rows only)"
        except Exception as e:  # noqa: BLE001
            err, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += err is not None
        print(f"{'FAIL' if err else 'ok  '} {name:28s} {n:8d} rows {time.time() - t:6.2f}s {err or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
