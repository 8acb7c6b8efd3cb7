"""Table scans."""
from pyspark.sql import DataFrame, SparkSession, functions as F


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages in the PAGE shape; a table without position or error_code gets them."""
    pages = spark.read.parquet(path)
    if "position" not in pages.columns:
        pages = pages.withColumn("position", F.col("page_id").cast("bigint"))
    if "error_code" not in pages.columns:
        pages = pages.withColumn("error_code", F.lit(None).cast("string"))
    return pages.select("page_id", "position", "url", "html", "error_code")
