"""Time every query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The first run of a query is its cold time, the second its warm time; both include building the plan.
The metric is the sum of warm times. ``python bench.py NAME ...`` times only those queries.
"""
import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


UNTIMED = {"q_report_files"}  # one file and folder per document: it times the disk


def run(item, spark, sf_dir):
    start = time.perf_counter()
    item.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from enrichflow.queries import CATALOG

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.minPartitionNum", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    cold, warm = {}, {}
    for name in sys.argv[1:] or [n for n in CATALOG if n not in UNTIMED]:
        item = CATALOG[name]
        cold[name] = round(run(item, spark, sf_dir), 3)
        warm[name] = round(run(item, spark, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "sum of warm query times",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
