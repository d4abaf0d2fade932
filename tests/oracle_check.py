"""Run every registered query and its SQL twin (DuckDB) and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from lendlens.session import local_session  # noqa: E402
from lendlens.sources.tables import TABLES  # noqa: E402
import __spark_entry__ as E  # noqa: E402


# Spark type -> the DuckDB type that the twin must return
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    """Rows, exact values and column types of a query against its SQL twin."""
    t = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    ts = time.time() - t
    if sql is None:
        return f"{name}: rows={len(srows)} (no oracle) {ts:.1f}s"
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    orows = res.fetchall()
    if sorted(scols) != sorted(ocols):
        return f"{name}: COLUMN MISMATCH spark={sorted(scols)} oracle={sorted(ocols)}"
    off = [(c, k, kinds[c]) for c, k in df.dtypes if TYPES.get(k, k) != kinds[c]]
    if off:
        return f"{name}: TYPE MISMATCH {off}"
    a, b = rows_of(scols, srows), rows_of(ocols, orows)
    if len(a) != len(b):
        return f"{name}: ROWCOUNT spark={len(a)} oracle={len(b)}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        cols = sorted(scols)
        detail = [[(cols[i], x[i], y[i]) for i in range(len(cols)) if x[i] != y[i]] for x, y in diff[:3]]
        return f"{name}: VALUE MISMATCH {len(diff)}/{len(a)} rows; first={detail}"
    return f"{name}: OK rows={len(a)} {ts:.1f}s"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            msg = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and continue
            msg = f"{name}: ERROR {type(e).__name__}: {str(e)[:800]}"
        if "OK" not in msg and "no oracle" not in msg:
            bad += 1
        print("RESULT " + msg, flush=True)
    print(f"failures: {bad}")


if __name__ == "__main__":
    main()
