"""Compare registered queries with their SQL in DuckDB: rows, names, types, values."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return repr(v)
    return str(v)


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    t1 = time.time()
    rel = con.sql(sql)
    want_cols = sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types)))
    order = [rel.columns.index(c) for c in want_cols]
    want = [tuple(r[k] for k in order) for r in rel.fetchall()]
    t2 = time.time()
    info = f"{name}: {len(rows)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s"
    if cols != want_cols:
        return False, f"{info} columns {cols} != {want_cols}"
    for f in df.schema.fields:
        if KINDS.get(f.dataType.simpleString()) != types[f.name]:
            return False, f"{info} type {f.name}: {f.dataType.simpleString()} != {types[f.name]}"
    a = sorted(tuple(map(norm, r)) for r in rows)
    b = sorted(tuple(map(norm, r)) for r in want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"{info} / {len(want)} values differ: {cols} {diff}"
    return True, info


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = entry.queries(), entry.oracle_sql()
    only = sys.argv[1:]
    con = connect(sf)
    bad = 0
    for name, fn in qs.items():
        if only and not any(name.startswith(o) or (o.endswith("_queries") and fn.__module__.endswith(o)) for o in only):
            continue
        try:
            if name in sqls:
                ok, info = compare(spark, con, name, fn, sqls[name], sf)
                ok = ok and ": 0 rows" not in info
            else:
                n = fn(spark, sf).count()
                ok, info = n > 0, f"{name}: {n} rows (no SQL)"
        except Exception as e:  # report and go on
            ok, info = False, f"{name}: {type(e).__name__} {str(e)[:600]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + info, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
