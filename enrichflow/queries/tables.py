"""The test tables read as the record, result, block and event tables the operators work on."""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from enrichflow import fixed_values as V
from enrichflow.functions.strings import archive_key
from enrichflow.operators import enrich, texts

QUESTIONS = ("What is new?", "What is missing?")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for heavy per-row text work.

    A session that asks for a least number of file partitions (the tests and the bench do, as each of their tables is
    one small file that Spark cannot split) gets the rows dealt out to as many.
    """
    least = spark.conf.get("spark.sql.files.minPartitionNum", None)
    rows = table(spark, sf_dir, name)
    return rows.repartition(int(least)) if least else rows


def document_key() -> Column:
    return archive_key(F.col("doc_id").cast("string"))


def record_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task per document; the source is the run."""
    doc_id = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("run_id"),
        F.col("doc_id").alias("ord"),
        document_key().alias("paper_key"),
        doc_id.alias("arxiv_id"),
        F.col("text").alias("title"),
        F.concat(F.lit("https://arxiv.org/abs/"), doc_id).alias("arxiv_url"),
        F.array(*(F.lit(q) for q in QUESTIONS)).alias("questions"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis branch: quality 1 is a success, 0 a failure, no label no row."""
    good = F.col("quality") == 1
    answer = F.concat(F.lit("Quality "), F.col("quality").cast("string"), F.lit(" of "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "labels").select(
        document_key().alias("paper_key"),
        F.when(good, V.SUCCESS).otherwise(V.FAILED).alias("status"),
        F.when(good, texts.complete_answer_analysis(document_key(), answer)).alias("analysis"),
        F.when(~good, V.ANALYSIS_ERROR).alias("error_code"),
    )


def likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric branch: toxic 0 is a success whose likes are the document number."""
    good = F.col("toxic") == 0
    return table(spark, sf_dir, "labels").select(
        document_key().alias("paper_key"),
        F.col("doc_id").cast("string").alias("arxiv_id"),
        F.when(good, F.col("doc_id")).alias("likes"),
        F.when(good, enrich.likes_text(F.col("doc_id"))).alias("raw_text"),
        F.when(good, V.SUCCESS).otherwise(V.FAILED).alias("status"),
        F.when(~good, V.LIKES_UNAVAILABLE).alias("error_code"),
    )


def prop_number() -> Column:
    """The number in an event's props."""
    return F.from_json("props", "k BIGINT")["k"]


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the cases a listing can have: not fetched, empty, and links that must be refused."""
    missing = F.col("url").contains("?page=2")
    html = F.replace(F.col("html"), F.lit('<a href="/t'), F.lit('<a href="http://plain.example/t'))
    emptied = F.when(F.col("url").contains("/es/"), F.replace(html, F.lit("<li>"), F.lit("<i>"))).otherwise(html)
    return text_table(spark, sf_dir, "pages").select(
        "page_id",
        F.col("page_id").alias("position"),
        "url",
        F.when(~missing, emptied).alias("html"),
        F.when(missing, F.lit(V.PAGE_UNAVAILABLE)).alias("error_code"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a task log: view enqueues, click claims, purchase and error are results.

    Four runs; a result with a small props number carries another id than its task.
    """
    user = F.col("user_id").cast("string")
    kind = (
        F.when(F.col("event_type") == "view", "enqueue")
        .when(F.col("event_type") == "click", "claim")
        .when(F.col("event_type") == "purchase", "success")
        .when(F.col("event_type") == "error", "failure")
        .otherwise("other")
    )
    number = prop_number()
    other_id = F.col("event_type").isin("purchase", "error") & (number < 10)
    ok, bad = F.col("event_type") == "purchase", F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")).alias("run_id"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        archive_key(user).alias("paper_key"),
        F.concat(F.lit("user "), user).alias("title"),
        F.concat(F.lit("https://arxiv.org/abs/"), user).alias("arxiv_url"),
        F.when(other_id, F.lit("other")).otherwise(user).alias("arxiv_id"),
        F.when(ok, number).alias("likes"),
        F.when(ok, enrich.likes_text(number)).alias("raw_text"),
        F.when(bad, F.lit(V.LIKES_UNAVAILABLE)).alias("error_code"),
    )
