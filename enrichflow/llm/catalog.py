"""Queries of this subpackage with the SQL they must equal, where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from enrichflow.queries.registry import Entry, Query

QUERIES: dict[str, Entry] = {}


def query(sql: str | None = None):
    def keep(run: Query) -> Query:
        QUERIES[run.__name__] = Entry(run, sql)
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import substring_dedup as op

    docs = table(spark, sf_dir, "documents")
    cut = (op.changed_texts(docs)
           .select("doc_id", "words_sha256", "n_removed", F.sha2("kept_text", 256).alias("cut_sha256"))
           .dropDuplicates(["doc_id", "words_sha256"]))
    return op.digests(docs).join(cut, ["doc_id", "words_sha256"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("cut_sha256", "words_sha256").alias("kept_sha256"))


@query()
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import jaccard_join as op

    return op.linked(table(spark, sf_dir, "documents"), size=3, percent=90)


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import toxicity as op
    from enrichflow.llm.learning import held_out

    docs = table(spark, sf_dir, "documents")
    model = op.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return op.scored(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")


@query()
def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import repetition as op

    return op.judged(table(spark, sf_dir, "documents"))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import quality as op
    from enrichflow.llm.learning import held_out

    docs = table(spark, sf_dir, "documents")
    model = op.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return op.scored(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= op.CUT).cast("int").alias("predicted"), "strength")


@query()
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import url_filter as op

    rules = [op.Rule("allow", "com", "/"), op.Rule("block", "example.com", "/en/"), op.Rule("allow", "www.example.com", "/en/"),
             op.Rule("block", "net", "/es/"), op.Rule("block", "net", "/fr/")]
    return op.judged(table(spark, sf_dir, "pages"), rules)


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def model_bytes(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as file:
        return file.read()


@query()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import pieces_codec as op

    return op.encoded(table(spark, sf_dir, "documents"), model_bytes())


@query()
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import decontaminate as op

    return op.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import line_dedup as op

    return op.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import chat as op

    return op.rendered(table(spark, sf_dir, "conversations"))


BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@query()
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import alignment as op

    with open(BYTE_TOKENIZER, encoding="utf-8") as file:
        return op.scored(table(spark, sf_dir, "documents"), file.read(), model_bytes())


@query()
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import mixing as op

    return op.mixed(table(spark, sf_dir, "documents"), weights=(1, 2, 3), limit=3)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents
           WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT count(*)::HUGEINT AS n_docs, coalesce(sum(len(ts)), 0)::HUGEINT AS n_terms FROM d WHERE len(ts) > 0),
t AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT item_id, r, doc_id, sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                 * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS score
      FROM i JOIN f USING (term) JOIN c USING (term) CROSS JOIN s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM k WHERE rank <= 10""")
def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from enrichflow.llm import treap as op

    return op.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
