"""Run registered queries on Spark and their checks on DuckDB over one directory; compare all rows.

    python tests/compare.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        if isinstance(v, bool):
            return str(v).lower()
        return "\0" if v is None else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


TYPES = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


def compare(df, con, sql):
    """None when equal, else what differs."""
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want_cols, want = rel.columns, rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(set(got_cols) ^ set(want_cols))}", len(got)
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    odd = {c: (t, want_types[c]) for c, t in df.dtypes if TYPES.get(t) != want_types[c] and want_types[c] != '"NULL"'}
    a, b = canonical(got, got_cols), canonical(want, want_cols)
    if a != b:
        extra, lost = list((set(a) - set(b)))[:3], list((set(b) - set(a)))[:3]
        return f"rows {len(a)} vs {len(b)}\n   spark only {extra}\n   duckdb only {lost}", len(got)
    return (f"types {odd}" if odd else None), len(got)


def main():
    import __spark_entry__ as e
    from bomscope.session import build_session

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, checks, bad = connect(sf_dir), e.oracle_sql(), []
    for name, fn in e.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in checks:
                diff, n = compare(df, con, checks[name])
            else:
                diff, n = "no check", len(df.collect())
        except Exception as ex:  # noqa: BLE001
            diff, n = f"{type(ex).__name__}: {str(ex)[:700]}", -1
        if diff:
            bad.append(name)
        print(f"{'ok  ' if not diff else 'DIFF'} {name} rows={n} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print(f"{len(bad)} differing: {bad}")


if __name__ == "__main__":
    main()
