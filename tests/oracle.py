"""Run registered queries and their SQL side by side: python -m tests.oracle sf_dir [name ...]"""

import os
import sys
import time
from collections import Counter


def connection(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name = f.removesuffix(".parquet")
        path = f"{sf_dir}/{f}"
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def normal(v):
    from datetime import datetime

    if isinstance(v, float):
        return f"{v:.9g}"
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


def differences(spark, name, sf_dir, c):
    """None, or what differs; and how many rows there are."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    rel = c.sql(e.oracle_sql()[name])
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}", 0
    at = [rel.columns.index(x) for x in df.columns]
    got = Counter(tuple(map(normal, r)) for r in df.collect())
    want = Counter(tuple(normal(r[k]) for k in at) for r in rel.fetchall())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}", sum(got.values())
    return None, sum(got.values())


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    c = connection(sys.argv[1])
    names = sys.argv[2:] or [n for n in e.queries() if n in e.oracle_sql()]
    for n in names:
        t = time.time()
        try:
            bad, rows = differences(spark, n, sys.argv[1], c)
        except Exception as x:  # noqa: BLE001
            bad, rows = f"{type(x).__name__}: {str(x)[:200]} ... {[l for l in str(x).splitlines() if l.startswith(chr(67)) or chr(58) in l][1:3]}", 0
        print("ok " if bad is None else "BAD", n, rows, f"{time.time() - t:.1f}s", bad or "", flush=True)
