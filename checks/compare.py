"""Run queries and their SQL side by side: python -m checks.compare [sf] [name ...]"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("reviewmill")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _cell(value):
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def compare(spark, db, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if name not in registry.SQL:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    cursor = db.execute(registry.SQL[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {df.columns} / {columns}"
    mine, theirs = rows_of(df.columns, got), rows_of(columns, want)
    if mine == theirs:
        return True, f"{len(mine)} rows, {took:.1f}s"
    only_mine = [r for r in mine if r not in set(theirs)][:2]
    only_theirs = [r for r in theirs if r not in set(mine)][:2]
    return False, f"{len(mine)}/{len(theirs)} rows; {only_mine} / {only_theirs}"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(registry.QUERIES)
    sf_dir = f"{os.environ.get('TESTDATA', '/root/testdata')}/sf{sf}"
    spark, db = session(), database(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, db, sf_dir, name)
        except Exception as error:  # show it and go on with the other queries
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note[:1500], flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
