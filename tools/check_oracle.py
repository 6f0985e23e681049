"""Run registered queries on Spark and their SQL on DuckDB and compare the results.

usage: python tools/check_oracle.py [--sf 0.01] [name or module ...]
"""

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    return v


def sort_key(row):
    return tuple((x is not None, str(type(x)), x) for x in row)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_df, con, sql):
    """'' when equal, else a short reason."""
    cols = sorted(spark_df.columns)
    got = [tuple(canon(r[c]) for c in cols) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: {sorted(names)} vs {cols}"
    pos = [names.index(c) for c in cols]
    want = [tuple(canon(r[i]) for i in pos) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows differ: spark {len(got)} duckdb {len(want)}"
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ {cols}; first spark {bad[0][0]} duckdb {bad[0][1]}"
    return ""


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from cohortlens.plans.catalog import REGISTRY
    from cohortlens.session import local_session
    spark = local_session()
    sf_dir = f"/root/testdata/sf{a.sf}"
    con = connect(sf_dir)
    fails = n = 0
    for name, q in REGISTRY.items():
        mod = q.build.__module__.rsplit(".", 1)[-1]
        if a.names and name not in a.names and mod not in a.names:
            continue
        n += 1
        t = time.time()
        try:
            df = q.run(spark, sf_dir)
            if q.sql is None:
                rows = df.count()
                msg, note = ("" if rows else "no rows"), f"rows only ({rows})"
            else:
                msg = compare(df, con, q.oracle())
                note = f"{df.count() if not msg and '-v' in sys.argv else ''}"
                if not msg and con.execute(f"SELECT count(*) FROM ({q.oracle()})").fetchone()[0] == 0:
                    note = "EMPTY RESULT"
        except Exception as e:  # report and go on
            msg, note = f"{type(e).__name__}: {str(e)[:700]}", ""
        fails += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {time.time() - t:6.2f}s {mod}.{name} {note} {msg}", flush=True)
    print(f"{n} queries, {fails} failures")
    sys.exit(bool(fails))


if __name__ == "__main__":
    main()
