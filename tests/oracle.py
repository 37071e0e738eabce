"""Holds queries against their SQL on the test tables: python tests/oracle.py DIR [NAME...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return round(value, 5)
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, pd.Timestamp):
        return str(value.tz_localize(None) if value.tz is None else value.tz_convert(None))
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    rows = [tuple(plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False)]
    return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


def connect(directory: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in sorted(os.listdir(directory)):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{directory}/{f}')")
    return con


def compare(spark, directory: str, name: str, query, sql: str, con=None) -> str:
    con = con or connect(directory)
    want = con.execute(sql).df()
    got = query(spark, directory).toPandas()
    if sorted(want.columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return "ok"
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} / {len(b)} rows; only here {only_a}; only in SQL {only_b}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(entry.queries())
    con = connect(sys.argv[1])
    for n in names:
        began = time.time()
        sql = entry.oracle_sql().get(n)
        try:
            said = compare(spark, sys.argv[1], n, entry.queries()[n], sql, con) if sql else f"rows {entry.queries()[n](spark, sys.argv[1]).count()}"
        except Exception as e:
            said = "FAILED " + str(e)[:700]
        print(f"{n}: {said} ({time.time() - began:.1f} s)", flush=True)
