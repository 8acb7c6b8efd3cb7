"""Which records become tasks: waterfall, keyword filter, order, top-n and the per-run cap."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from enrichflow import fixed_values as V
from enrichflow.functions.strings import archive_key, fold_title, once
from enrichflow.functions.urls import ARCHIVE, IdShape, canonical_id
from enrichflow.operators.keyed import first_n_cutoff
from enrichflow.operators.keywords import containing
from enrichflow.operators.ranking import ranked
from enrichflow.schemas import RECORD_TASK

NO_LINK, TOPIC_MISMATCH, INVALID_LINK, SELECTED = "no_link", "topic_mismatch", "invalid_link", "selected"
DISPOSITIONS = (NO_LINK, TOPIC_MISMATCH, INVALID_LINK, SELECTED)


def matches_any(title: Column, topics: Sequence[str]) -> Column:
    """Folded title contains at least one folded topic; no topics means every title."""
    if not topics:
        return F.lit(True)
    wanted = F.array(*(fold_title(F.lit(t)) for t in topics))
    return F.exists(wanted, lambda t: F.contains(title, t))


def waterfall(reasons: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first reason that applies."""
    (name, test), *rest = reasons
    chosen = F.when(test, F.lit(name))
    for name, test in rest:
        chosen = chosen.when(test, F.lit(name))
    return chosen.otherwise(F.lit(otherwise))


def check_selection(topics: Sequence[str], questions: Sequence[str], max_records: int) -> None:
    """Shape of a selection; how large one may be is a rule of the run input (``contracts.run_input_violations``)."""
    if max_records < 0:
        raise ValueError("max_papers must not be negative")
    if any(not t.strip() for t in topics):
        raise ValueError("topics must not contain blank values")
    if not questions or any(not q.strip() for q in questions):
        raise ValueError("questions must contain non-blank values")


def on_topic(folded: DataFrame, topics: DataFrame, key: str = "detail_url", topics_folded: bool = False) -> DataFrame:
    """(key): titles that contain a topic of a table of any size; an empty table selects none.

    ``topics_folded``: topics are compared as they are, blanks at their ends included.
    """
    topic = F.col(topics.columns[0])
    words = topics.select((topic if topics_folded else fold_title(topic)).alias("keyword"))
    return containing(folded, words, key, "folded_title").select(key).distinct()


def dispose(
    seeds: DataFrame, topics: Sequence[str] | DataFrame = (), ids: IdShape = ARCHIVE, key: str = "detail_url", topics_folded: bool = False
) -> DataFrame:
    """Adds ``folded_title`` (of linked records), ``arxiv_id`` and ``disposition`` to unique records.

    ``topics`` is a short list, tested title by title, or a table whose first column holds them, joined by an index of their n-grams;
    then ``key`` must tell the records apart, and ``topics_folded`` takes topics cut out of folded text unchanged.
    """
    linked = F.col("arxiv_url").isNotNull()
    folded = seeds.withColumn("folded_title", once(F.when(linked, fold_title(F.col("title"))))).withColumn(
        "arxiv_id", once(canonical_id(F.col("arxiv_url"), ids))
    )
    if isinstance(topics, DataFrame):
        found = on_topic(folded.filter(linked), topics, key, topics_folded).withColumn("_on_topic", F.lit(True))
        folded, fits = folded.join(found, key, "left"), F.col("_on_topic").isNotNull()
    else:
        fits = matches_any(F.col("folded_title"), topics)
    return folded.withColumn(
        "disposition",
        waterfall(
            [
                (NO_LINK, F.col("arxiv_url").isNull()),
                (TOPIC_MISMATCH, ~fits),
                (INVALID_LINK, F.col("arxiv_id").isNull()),
            ],
            SELECTED,
        ),
    ).drop("_on_topic")


def selected_tasks(disposed: DataFrame, questions: Sequence[str], max_records: int = 0) -> DataFrame:
    """Task rows with their (folded title, detail URL) order in ``ord``.

    A limit takes the first rows of that order (top-n per task, then one merge). Without a limit
    nothing is sorted: the order is a column, and only a sink that needs it sorts.
    """
    tasks = (
        disposed.filter(F.col("disposition") == SELECTED)
        .withColumn("paper_key", archive_key(F.col("arxiv_id")))
        .withColumn("questions", F.array(*(F.lit(q.strip()) for q in questions)))
    )
    if max_records:
        tasks = tasks.orderBy("folded_title", "detail_url").limit(max_records)
    return tasks.select(*RECORD_TASK.names, F.struct("folded_title", "detail_url").alias("ord"))


def select_records(
    seeds: DataFrame, topics: Sequence[str], questions: Sequence[str], max_records: int = 0, ids: IdShape = ARCHIVE
) -> tuple[DataFrame, DataFrame]:
    """(tasks, disposed records)."""
    check_selection(topics, questions, max_records)
    disposed = dispose(seeds, topics, ids)
    return selected_tasks(disposed, questions, max_records), disposed


def rejected_links(disposed: DataFrame, *groups: str) -> DataFrame:
    return disposed.filter(F.col("disposition") == INVALID_LINK).select(
        *groups, "title", F.lit(V.INVALID_ARCHIVE_URL).alias("error_code"), "position", "ord"
    )


def likes_tasks(tasks: DataFrame) -> DataFrame:
    """The four columns the metric branch needs."""
    return tasks.select("paper_key", "title", "arxiv_url", "arxiv_id")


def cap_new(remaining: DataFrame, limit: int, run: str = "run_id", order: str = "ord") -> DataFrame:
    """Adds ``scheduled``: True for the first ``limit`` rows of a run in order; 0 schedules all."""
    if limit == 0:
        return remaining.withColumn("scheduled", F.lit(True))
    cutoff = first_n_cutoff(remaining, [run], order, limit)
    return (
        remaining.join(cutoff, run, "left")
        .withColumn("scheduled", F.col(order) <= F.col("cutoff"))
        .drop("cutoff")
    )


def in_waves(remaining: DataFrame, size: int, limit: int = 0, run: str = "run_id", order: str = "ord") -> DataFrame:
    """Adds ``wave``: 0 for the first ``size`` rows of a run in order, 1 for the next, and so on; NULL beyond ``limit`` (0: none).

    Rows are ranked once by ranges of the order, so a run may be of any size.
    """
    placed = ranked(remaining, [F.col(order).asc()], [run], "_rank", F.xxhash64("paper_key"))
    within = F.col("_rank") < limit if limit else F.lit(True)
    return placed.withColumn("wave", F.when(within, F.floor(F.col("_rank") / size).cast("int"))).drop("_rank")


def deferred(rows: DataFrame, code: str = V.DEFERRED_BY_LIMIT, mode: str | None = None) -> DataFrame:
    """FAILED analysis rows for tasks that were not started; they are reported, never logged."""
    return rows.select(
        *(c for c in rows.columns if c == "run_id"),
        "paper_key",
        F.lit(V.FAILED).alias("status"),
        F.lit(code).alias("error_code"),
        F.lit(None).cast("string").alias("error_detail"),
        F.lit(mode).cast("string").alias("analysis_mode"),
        "questions",
    )
