"""Runs a registered query and its SQL on the same tables and compares the results."""

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, repr(float(v)))
    if hasattr(v, "as_integer_ratio"):
        return (2, repr(float(v)))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return (3, v.isoformat()[:10] if not isinstance(v, datetime.datetime) else v.isoformat())
    if isinstance(v, (list, tuple)):
        return (4, repr([canon(x) for x in v]))
    if isinstance(v, dict):
        return (5, repr({k: canon(x) for k, x in v.items()}))
    return (6, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def close(a, b):
    if a == b:
        return True
    if a[0] == b[0] == 2:
        return math.isclose(float(a[1]), float(b[1]), rel_tol=1e-9, abs_tol=1e-9)
    return False


def compare(spark_df, con, sql):
    """(status, detail): status is exact, close or DIFF."""
    mine = spark_df.collect()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(spark_df.columns) != sorted(columns):
        return "DIFF", f"columns {sorted(spark_df.columns)} / {sorted(columns)}"
    a, b = rows_of(spark_df.columns, mine), rows_of(columns, theirs)
    if len(a) != len(b):
        return "DIFF", f"rows {len(a)} / {len(b)}"
    if a == b:
        return ("exact" if a else "EMPTY"), f"{len(a)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    worse = [(x, y) for x, y in bad if not all(close(p, q) for p, q in zip(x, y))]
    if worse:
        return "DIFF", f"{len(worse)} of {len(a)} rows, first: {worse[0]}"
    return "close", f"{len(bad)} of {len(a)} rows, first: {bad[0]}"


def main():
    from vaportrail.session import get_session
    from workload.registry import QUERIES

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_session("check", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, (fn, sql) in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if sql is None:
                status, detail = "rows", f"{len(df.collect())} rows"
            else:
                status, detail = compare(df, con, sql)
        except Exception as e:  # report and go on
            status, detail = "ERROR", str(e)[:1500]
        print(f"{status:6} {time.time() - start:6.2f}s {name}: {detail[:1500]}", flush=True)


if __name__ == "__main__":
    main()
