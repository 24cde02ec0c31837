"""Compare registered queries with DuckDB on the same tables.

    python tests/oracle.py [sf] [name ...]
"""

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return ("n", "nan" if math.isnan(f) else repr(round(f, 9) + 0.0))
    if isinstance(v, dict):
        return ("d", str(sorted((k, norm(x)) for k, x in v.items())))
    if isinstance(v, (list, tuple)):
        return ("l", str([norm(x) for x in v]))
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    return ("s", str(v))


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted([tuple(norm(r[i]) for i in order) for r in rows])


def spark_rows(df):
    return canon(df.columns, [tuple(x.asDict(True) if hasattr(x, "asDict") else x for x in r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return canon([d[0] for d in cur.description], cur.fetchall())


def compare(a, b):
    if a[0] != b[0]:
        return f"columns {a[0]} vs {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} vs {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return None if not bad else f"{len(bad)} of {len(a[1])} rows differ, first {bad[0]}"


def main():
    import __spark_entry__ as entry
    from plantwave.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                   "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    q, s = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or q:
        t = time.time()
        try:
            got = spark_rows(q[name](spark, sf_dir))
            t1 = time.time()
            verdict = "rows-only" if name not in s else compare(got, duck_rows(con, s[name]))
            line = f"{verdict or 'ok'}  rows={len(got[1])}"
        except Exception as e:  # report and go on
            t1 = time.time()
            verdict = line = "ERROR " + str(e)[:600]
        bad += verdict not in (None, "rows-only")
        print(f"{name:32s} {t1 - t:6.2f}s {time.time() - t1:6.2f}s {line}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
