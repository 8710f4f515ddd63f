"""Runs queries against their SQL in DuckDB: python tests/oracle.py [folder] [name ...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v) -> object:
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, pd.Timestamp | datetime.datetime):
        return pd.Timestamp(v).tz_localize(None).isoformat()
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float):
        return round(float(v), 9)
    return str(v)


def rows(df: pd.DataFrame) -> Counter:
    df = df[sorted(df.columns)]
    return Counter(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(sql_df.columns)}"
    a, b = rows(spark_df), rows(sql_df)
    if a != b:
        return f"{len(spark_df)} and {len(sql_df)} rows; only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}"
    return ""


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            said = differences(got, con.sql(sql[name]).df()) if name in sql else "no SQL"
        except Exception as e:  # noqa: BLE001
            said, got = f"ERROR {str(e)[:900]}", []
        bad += bool(said and said != "no SQL")
        print(f"{name}: {len(got)} rows, {time.time() - began:.1f} s {said or 'equal'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main((sys.argv + ["/root/testdata/sf0.001"])[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:]))
