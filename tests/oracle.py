"""Run queries next to their SQL in DuckDB and compare rows. ``python tests/oracle.py SF_DIR [NAME ...]``"""
import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.minPartitionNum", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def compare(spark, connection, name, item, sf_dir):
    """Difference as text, None when equal."""
    frame = item.run(spark, sf_dir)
    mine = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if item.sql is None:
        return None if mine else "no rows"
    result = connection.execute(item.sql)
    columns = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    theirs = rows(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(columns)}"
    spark_kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
                   "date": "DATE", "timestamp": "TIMESTAMP"}
    off = {c: (t, kinds[c]) for c, t in frame.dtypes if spark_kinds.get(t) != kinds[c]}
    if mine == theirs:
        return f"types {off}" if off else None
    only_mine, only_theirs = set(mine) - set(theirs), set(theirs) - set(mine)
    return f"{len(mine)} and {len(theirs)} rows; mine {sorted(only_mine, key=repr)[:3]} theirs {sorted(only_theirs, key=repr)[:3]} {off}"


if __name__ == "__main__":
    from enrichflow.queries import CATALOG

    sf_dir, *names = sys.argv[1:]
    spark, connection = session(), duck(sf_dir)
    for name in names or CATALOG:
        start = time.time()
        try:
            problem = compare(spark, connection, name, CATALOG[name], sf_dir)
        except Exception as error:
            problem = "ERROR " + "".join(traceback.format_exception_only(error))[:1500]
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}"[:2000], flush=True)
