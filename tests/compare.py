"""Run queries in Spark and their SQL twins in DuckDB, and compare rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "is_finite"):  # Decimal
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def difference(spark, con, name, query, sql, sf_dir):
    """None when equal, else a short description."""

    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; only here {sorted(set(got) - set(want), key=repr)[:3]}; only there {sorted(set(want) - set(got), key=repr)[:3]}"
    if got != want:
        pairs = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(pairs)} of {len(got)} rows differ, first {pairs[0]}"
    types = {type(a) for r in got for a in r} ^ {type(a) for r in want for a in r}
    return f"types {types}" if types else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
    import __spark_entry__ as entry
    from spanloom.session import local_session

    sf_dir = sys.argv[1]
    spark, con = local_session(), tables(sf_dir)
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        sql = entry.oracle_sql().get(name)
        start = time.time()
        try:
            if sql is None:
                said = f"no SQL, {entry.queries()[name](spark, sf_dir).count()} rows"
            else:
                said = difference(spark, con, name, entry.queries()[name], sql, sf_dir) or "equal"
        except Exception as e:  # noqa: BLE001
            said = f"FAILED {str(e)[:700]}"
        print(f"@@ {name}: {said} ({time.time() - start:.1f}s)", flush=True)
