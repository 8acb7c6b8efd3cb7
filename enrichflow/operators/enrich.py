"""Row enrichment with failure isolation, metric results, authorization cut-off and source fallback."""
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from enrichflow import fixed_values as V
from enrichflow.functions.strings import fold_case, is_blank, strip
from enrichflow.operators.jsonops import strict_path_bigint
from enrichflow.schemas import ANALYSIS, ANALYSIS_RESULT, TEXT, TEXTS, row

_ATTEMPT = row(
    paper_key=TEXT, status=TEXT, analysis=ANALYSIS, error_code=TEXT, error_type=TEXT, error_message=TEXT,
    analysis_mode=TEXT, questions=TEXTS,
)
def redact(text: Column) -> Column:
    """Replace token-like values, together with a scheme word before them, by ``<redacted>``."""
    return F.regexp_replace(text, V.SECRET_PATTERN, "$1=<redacted>")


def error_detail(kind: Column, message: Column, most: int | None = None) -> Column:
    """``Type: message`` without secrets; whole, unless a stored shape asks for at most ``most`` characters."""
    said = F.when(is_blank(message), F.lit("No error message")).otherwise(strip(message))
    detail = F.concat(kind, F.lit(": "), redact(said))
    return detail if most is None else F.left(detail, F.lit(most))


def is_auth_failure(message: Column) -> Column:
    folded = fold_case(message)
    hits = [F.contains(folded, F.lit(mark)) for mark in V.AUTH_FAILURE_MARKS]
    return F.coalesce(hits[0] | hits[1] | hits[2], F.lit(False))


def enrich_rows(
    tasks: DataFrame,
    make_function: Callable[[], Callable[[dict], dict]],
    mode: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Call a function once per task and return ANALYSIS_RESULT rows; an exception fails its row only.

    ``make_function`` runs once per task partition and returns the callable (build clients there).
    The callable gets the task row as a dict and returns ANALYSIS fields. ``partitions`` bounds the
    number of concurrent callers. A ``run_id`` column is handed on. Every task is called: the cut-off
    after an authorization failure is drawn between waves (``flow.analyse``), so it does not depend on
    how rows lie in partitions. Write the result before using it twice: a second action calls again.
    """
    if not {"paper_key", "questions"} <= set(tasks.columns):
        raise ValueError("tasks need paper_key and questions")
    carried = [tasks.schema["run_id"]] if "run_id" in tasks.columns else []
    shape = T.StructType([*carried, *_ATTEMPT.fields])
    arrow_schema = to_arrow_schema(shape)
    empty = {f.name: [] for f in ANALYSIS.fields if f.dataType == TEXTS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make_function()
        for batch in batches:
            rows = []
            for task in batch.to_pylist():
                out = {
                    "paper_key": task["paper_key"],
                    "analysis_mode": mode,
                    "questions": task["questions"],
                }
                out |= {f.name: task[f.name] for f in carried}
                try:
                    found = {"paper_key": task["paper_key"], "answer_by_question": {}} | empty | call(task)
                    rows.append(out | {"status": V.SUCCESS, "analysis": found})
                except Exception as error:
                    rows.append(
                        out
                        | {
                            "status": V.FAILED,
                            "error_code": V.ANALYSIS_ERROR,
                            "error_type": type(error).__name__,
                            "error_message": str(error),
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    source = tasks if partitions is None else tasks.repartition(partitions)
    attempts = source.mapInArrow(run, shape)
    detail = F.when(F.col("status") == V.FAILED, error_detail(F.col("error_type"), F.col("error_message")))
    return attempts.withColumn("error_detail", detail).select(*(f.name for f in carried), *ANALYSIS_RESULT.names)


def unavailable(tasks: DataFrame, code: str, mode: str | None = None) -> DataFrame:
    """FAILED analysis rows for every task when a branch cannot run at all."""
    carried = [c for c in tasks.columns if c == "run_id"]
    return tasks.select(
        *carried,
        "paper_key",
        F.lit(V.FAILED).alias("status"),
        F.lit(None).cast(ANALYSIS).alias("analysis"),
        F.lit(code).alias("error_code"),
        F.lit(None).cast("string").alias("error_detail"),
        F.lit(mode).cast("string").alias("analysis_mode"),
        "questions",
    )


def likes_text(likes: Column) -> Column:
    return F.concat(likes.cast("string"), F.when(likes == 1, F.lit(" Like")).otherwise(F.lit(" Likes")))


def metric_results(tasks: DataFrame, responses: DataFrame) -> DataFrame:
    """LIKES_RESULT per task from a response table (arxiv_id, http_status, payload).

    404 is NOT_FOUND. No response, another error status or an unusable payload is UNAVAILABLE. Of repeated
    responses for an id one counts: a usable one before others, then the largest (status, likes).
    """
    likes = strict_path_bigint(F.col("payload"), V.METRIC_PATH)
    usable = F.col("http_status").between(200, 299) & F.col("likes").isNotNull()
    answered = (
        responses.select("arxiv_id", "http_status", likes.alias("likes"))
        .groupBy("arxiv_id")
        .agg(F.max(F.struct(F.coalesce(usable, F.lit(False)).alias("usable"), "http_status", "likes")).alias("best"))
        .select("arxiv_id", "best.http_status", "best.likes")
    )
    joined = tasks.select(*[c for c in tasks.columns if c in ("paper_key", "arxiv_id", "ord", "run_id")]).join(
        answered, "arxiv_id", "left"
    )
    good = F.coalesce(F.col("http_status").between(200, 299), F.lit(False)) & F.col("likes").isNotNull()
    carried = [c for c in joined.columns if c in ("ord", "run_id")]
    return joined.select(
        *carried,
        "paper_key",
        "arxiv_id",
        F.when(good, F.col("likes")).alias("likes"),
        F.when(good, likes_text(F.col("likes"))).alias("raw_text"),
        F.when(good, V.SUCCESS).otherwise(V.FAILED).alias("status"),
        F.when(~good, F.when(F.col("http_status") == 404, V.LIKES_NOT_FOUND).otherwise(V.LIKES_UNAVAILABLE)).alias(
            "error_code"
        ),
    )


def cut_off(attempts: DataFrame, run: str = "run_id", order: str = "ord", detail: str = "error_detail") -> DataFrame:
    """Attempt log with ``deferred`` set on every row after the run's first authorization failure.

    The first failure is a keyed minimum joined back, so no task holds a whole run.
    """
    first = attempts.filter(is_auth_failure(F.col(detail))).groupBy(run).agg(F.min(order).alias("_closed_at"))
    return (
        attempts.join(first, run, "left")
        .withColumn("deferred", F.coalesce(F.col(order) > F.col("_closed_at"), F.lit(False)))
        .drop("_closed_at")
    )


def after_cut_off(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows for the log, deferred rows with their code): deferred rows are never logged."""
    logged = flagged.filter(~F.col("deferred")).drop("deferred")
    late = (
        flagged.filter("deferred")
        .drop("deferred")
        .withColumns(
            {
                "status": F.lit(V.FAILED),
                "error_code": F.lit(V.DEFERRED_BY_CUTOFF),
                "error_detail": F.lit(None).cast("string"),
            }
        )
    )
    return logged, late


def with_fallback(keys: DataFrame, primary: DataFrame, secondary: DataFrame, key: str, value: str) -> DataFrame:
    """Primary value if usable, else the secondary one, else an error code; ``source`` tells which."""
    one = primary.filter(~is_blank(F.col(value))).select(key, F.col(value).alias("_first"))
    two = secondary.filter(~is_blank(F.col(value))).select(key, F.col(value).alias("_second"))
    joined = keys.select(key).join(one, key, "left").join(two, key, "left")
    return joined.select(
        key,
        F.coalesce("_first", "_second").alias(value),
        F.when(F.col("_first").isNotNull(), "primary").when(F.col("_second").isNotNull(), "fallback").alias("source"),
        F.when(F.coalesce("_first", "_second").isNull(), F.lit(V.EVIDENCE_UNAVAILABLE)).alias("error_code"),
    )
