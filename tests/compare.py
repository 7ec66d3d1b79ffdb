"""Run registered queries against their SQL on one data set.

usage: python tests/compare.py SF_DIR [substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v, digits=None):
    if v is None:
        return None
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if digits is not None:
            return float(f"{v:.{digits}g}")
        return v + 0.0
    return v


def rows_of(cols, rows, digits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x).__name__ in ("int", "float")), str(x)) for x in t))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "rows", f"{len(got)} rows, {t1 - t0:.1f}s", t1 - t0
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    info = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(ocols):
        return "COLS", f"{sorted(df.columns)} != {sorted(ocols)}", t1 - t0
    a, b = rows_of(df.columns, got), rows_of(ocols, want)
    if a == b:
        return "ok", info, t1 - t0
    if len(a) == len(b):
        a8, b8 = rows_of(df.columns, got, 9), rows_of(ocols, want, 9)
        if a8 == b8:
            n = sum(x != y for x, y in zip(a, b))
            return "near", f"{info} ({n} differ beyond 9 digits)", t1 - t0
    sa, sb = set(a), set(b)
    return "DIFF", f"{info}, want {len(b)}\n   spark only {sorted(sa - sb, key=str)[:3]}\n   sql only   {sorted(sb - sa, key=str)[:3]}", t1 - t0


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir, pats = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    q, o = e.queries(), e.oracle_sql()
    tally = {}
    for key in q:
        if pats and not any(p in key for p in pats):
            continue
        import threading
        stop = threading.Timer(float(os.environ.get("LIMIT", "90")), lambda k=key: (print(f"TIME  {k}", flush=True), spark.sparkContext.cancelAllJobs()))
        hard = threading.Timer(2 * float(os.environ.get("LIMIT", "90")), lambda k=key: (print(f"HANG  {k}", flush=True), os._exit(3)))
        stop.start(), hard.start()
        try:
            st, info, _ = compare(spark, con, key, q[key], o.get(key), sf_dir)
        except Exception as ex:
            st, info = "ERR", "".join(traceback.format_exception_only(ex))[:700]
            if os.environ.get("TB"):
                traceback.print_exc()
        stop.cancel(), hard.cancel()
        tally[st] = tally.get(st, 0) + 1
        print(f"{st:5} {key}: {info}", flush=True)
    print(tally)


if __name__ == "__main__":
    main()
