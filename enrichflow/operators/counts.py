"""Run counters, statuses, histograms and warning rows."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from enrichflow import fixed_values as V
from enrichflow.operators.selection import DISPOSITIONS, SELECTED


def run_status(total: Column, completed: Column, failed: Column) -> Column:
    """Emptiness is tested first, as an all-of over no rows is unknown."""
    return (
        F.when((total > 0) & (completed == total), F.lit(V.RUN_COMPLETED))
        .when((total == 0) | (failed == total), F.lit(V.RUN_FAILED))
        .otherwise(F.lit(V.RUN_PARTIAL))
    )


def run_counts(results: DataFrame, *groups: str) -> DataFrame:
    """Branch and outcome counters with the run status; one row without groups, even for no results."""
    analysed = F.col("analysis").isNotNull()
    counted = results.groupBy(*groups).agg(
        F.count("*").alias("selected"),
        F.count_if(F.col("likes.status") == V.SUCCESS).alias("likes_success"),
        F.count_if(F.col("likes.status") == V.FAILED).alias("likes_failed"),
        F.count_if(analysed).alias("analysis_success"),
        F.count_if(~analysed).alias("analysis_failed"),
        F.count_if(F.col("status") == V.COMPLETED).alias("completed"),
        F.count_if(F.col("status") == V.PARTIAL).alias("partial"),
        F.count_if(F.col("status") == V.FAILED).alias("failed"),
    )
    return counted.withColumn("run_status", run_status(F.col("selected"), F.col("completed"), F.col("failed")))


def disposition_counts(disposed: DataFrame, *groups: str, names: Sequence[str] = DISPOSITIONS) -> DataFrame:
    """One column per disposition (zero when absent), one pass, no join against a list of names."""
    return disposed.groupBy(*groups).agg(*(F.count_if(F.col("disposition") == n).alias(n) for n in names))


def initial_counts(disposed: DataFrame, *groups: str, tasks: DataFrame | None = None) -> DataFrame:
    """discovered, skipped (all reasons together) and selected before any enrichment.

    A selection with a limit has fewer tasks than selected records; hand over ``tasks``, and they are what counts.
    """
    per = disposition_counts(disposed, *groups)
    skipped = sum((F.col(n) for n in DISPOSITIONS if n != SELECTED), F.lit(0))
    counted = per.select(
        *groups,
        (skipped + F.col(SELECTED)).cast("bigint").alias("discovered"),
        skipped.cast("bigint").alias("skipped"),
        F.col(SELECTED).alias("selected"),
    )
    if tasks is None:
        return counted
    nothing = F.lit(0).cast("bigint")
    own = tasks.groupBy(*groups).agg(F.count("*").alias("selected")).withColumns({"discovered": nothing, "skipped": nothing})
    both = counted.withColumn("selected", nothing).unionByName(own)
    return both.groupBy(*groups).agg(*(F.sum(c).alias(c) for c in ("discovered", "skipped", "selected")))


def state_histogram(
    tasks: DataFrame, groups: Sequence[str], states: Sequence[str] = V.TASK_STATES, state: str = "state"
) -> DataFrame:
    """(groups, state, n) for every state, zero filled: conditional counts turned into rows."""
    counted = tasks.groupBy(*groups).agg(*(F.count_if(F.col(state) == s).alias(s) for s in states))
    return counted.unpivot(list(groups), list(states), state, "n")


def warning_rows(failures: DataFrame, rejected: DataFrame, *groups: str) -> DataFrame:
    """All warnings of a run in order: page failures by page, then rejected links by position.

    Order is carried as (phase, position, ord) columns; the list is never gathered into one row.
    """
    zero = F.lit(0).cast("bigint")
    pages = failures.select(
        *groups, F.lit(0).alias("phase"), F.col("position").cast("bigint").alias("position"), zero.alias("ord"),
        F.col("error_code").alias("code"),
    )
    links = rejected.select(
        *groups, F.lit(1).alias("phase"), F.col("position").cast("bigint").alias("position"),
        F.col("ord").cast("bigint").alias("ord"), F.col("error_code").alias("code"),
    )
    return pages.unionByName(links)


def warning_summary(warnings: DataFrame, *groups: str) -> DataFrame:
    """Array of (phase, code, n) per run: bounded by the code vocabulary, not by the run size."""
    per_code = warnings.groupBy(*groups, "phase", "code").agg(F.count("*").alias("n"))
    return per_code.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("phase", "code", "n"))).alias("warnings")
    )
