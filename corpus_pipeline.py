"""Corpus pipeline: toxic documents go, repeated lines go, near duplicates go, benchmark leaks go, texts become tokens.

Each stage reads what the one before stored. All but the last return the columns of ``documents``; the last returns token ids.
Rows without ``doc_id`` pass the stages that compare documents unchanged.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from enrichflow.llm import decontaminate, jaccard_join, line_dedup, pieces_codec, toxicity
from enrichflow.llm.catalog import model_bytes
from enrichflow.queries.registry import Entry
from enrichflow.sources.scratch import written


BATCH_ROWS = 1000  # 10,000 documents of 2 KB, Spark's default, took over 200 MB more of an executor outside its heap


def _small_batches(spark: SparkSession) -> None:
    """Rows that go to Python at once; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from the labels of the documents given."""
    _small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one has; a document that loses all its words goes."""
    _small_batches(spark)
    cut = line_dedup.deduplicated(docs)
    left = cut.filter((F.size("removed") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    own = {"n_chars": F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.char_length("text"))} if "n_chars" in docs.columns else {}
    return left.withColumns(own).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates (five words, similarity 0.8)."""
    _small_batches(spark)
    gone = jaccard_join.linked(docs, size=5, percent=80).filter("component_id <> doc_id").select("doc_id")
    return docs.join(written(gone), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    gone = decontaminate.leaks(docs, _table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(written(gone), "doc_id", "left_anti").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left."""
    _small_batches(spark)
    return pieces_codec.encoded(docs, model_bytes())


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_dedup_stage), ("n-gram Jaccard join", near_duplicate_stage),
          ("benchmark decontamination", decontamination_stage), ("SentencePiece encoding", encoding_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each on the stored rows of the one before."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


ORACLE_SQL = None  # learned scores and token ids are beyond SQL; tests/llm/test_pipeline.py holds a brute-force version
ENTRY = Entry(run, ORACLE_SQL)
