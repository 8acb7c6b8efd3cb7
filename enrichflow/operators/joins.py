"""Attaching branch results to records: integrity checks, default rows, resume and merge."""
from pyspark.sql import Column, DataFrame, functions as F

from enrichflow import fixed_values as V
from enrichflow.functions.strings import fold_case, strip
from enrichflow.schemas import LIKES_RESULT, RECORD_TASK


def key_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows per key; copies of a hot key collapse before the shuffle."""
    return df.groupBy(key).agg(F.count("*").alias(name))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return key_counts(df, key, "n").filter(F.col("n") > 1)


def orphan_keys(df: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Keys of ``df`` (with row counts) that no record has. Both sides are reduced to keys first."""
    return key_counts(df, key, "n").join(records.select(key).distinct(), key, "left_anti")


def completeness(records: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """Keys for which records and results do not match one to one, with both counts."""
    expected = records.groupBy(*keys).agg(F.count("*").alias("expected"))
    found = results.groupBy(*keys).agg(F.count("*").alias("found"))
    both = expected.join(found, list(keys), "full_outer").na.fill(0, ["expected", "found"])
    return both.filter((F.col("expected") != 1) | (F.col("found") != 1))


def integrity_report(records: DataFrame, analyses: DataFrame, likes: DataFrame, *keys: str) -> DataFrame:
    """Every reason why the three tables may not be joined: (code, keys, n). The key is ``paper_key`` if none is named."""
    return key_mismatches(records, analyses, likes, *keys).unionByName(identity_mismatches(records, likes, *keys))


def key_mismatches(records: DataFrame, analyses: DataFrame, likes: DataFrame, *keys: str) -> DataFrame:
    """Keys that a table repeats or that no record has.

    One keyed aggregate over the union of the three key columns answers uniqueness and orphan
    questions together.
    """
    keys = keys or ("paper_key",)

    def side(df: DataFrame, name: str) -> DataFrame:
        flags = [F.lit(int(name == other)).cast("bigint").alias(other) for other in ("record", "analysis", "likes")]
        return df.select(*keys, *flags)

    tally = (
        side(records, "record")
        .unionByName(side(analyses, "analysis"))
        .unionByName(side(likes, "likes"))
        .groupBy(*keys)
        .agg(F.sum("record").alias("record"), F.sum("analysis").alias("analysis"), F.sum("likes").alias("likes"))
    )
    no_record = F.col("record") == 0
    found = F.array_compact(
        F.array(
            F.when(F.col("record") > 1, F.struct(F.lit(V.RECORD_MISMATCH).alias("code"), F.col("record").alias("n"))),
            F.when(
                (F.col("analysis") > 1) | (no_record & (F.col("analysis") > 0)),
                F.struct(F.lit(V.ANALYSIS_MISMATCH).alias("code"), F.col("analysis").alias("n")),
            ),
            F.when(
                (F.col("likes") > 1) | (no_record & (F.col("likes") > 0)),
                F.struct(F.lit(V.LIKES_MISMATCH).alias("code"), F.col("likes").alias("n")),
            ),
        )
    )
    return tally.select(*keys, F.explode(found).alias("hit")).select("hit.code", *keys, "hit.n")


def identity_mismatches(records: DataFrame, likes: DataFrame, *keys: str) -> DataFrame:
    """Keys whose likes carry another id than the record, by id; ``n`` counts the pairs of a row and a record that disagree."""
    keys = keys or ("paper_key",)

    def ids(df: DataFrame, own: str, name: str) -> DataFrame:
        return df.groupBy(*keys, F.col("arxiv_id").alias(own)).agg(F.count("*").alias(name))

    return (
        ids(likes, "arxiv_id", "_rows")
        .join(ids(records, "own_id", "_records"), list(keys))
        .filter(~F.col("arxiv_id").eqNullSafe(F.col("own_id")))
        .groupBy(*keys, "arxiv_id")
        .agg(F.sum(F.col("_rows") * F.col("_records")).alias("n"))
        .select(F.lit(V.LIKES_MISMATCH).alias("code"), *keys, "n")
    )


def require_integrity(records: DataFrame, analyses: DataFrame, likes: DataFrame, *keys: str) -> None:
    bad = integrity_report(records, analyses, likes, *keys).first()
    if bad:
        raise ValueError(bad["code"])


def outcome(likes_ok: Column, analysis_ok: Column) -> Column:
    """COMPLETED with both branches, PARTIAL with one, FAILED with none."""
    return (
        F.when(likes_ok & analysis_ok, F.lit(V.COMPLETED))
        .when(likes_ok | analysis_ok, F.lit(V.PARTIAL))
        .otherwise(F.lit(V.FAILED))
    )


def _shared_keys(*frames: DataFrame) -> list[str]:
    """``paper_key``, and ``run_id`` where all frames have it: one paper may be in several runs."""
    return [*(["run_id"] if all("run_id" in f.columns for f in frames) else []), "paper_key"]


def join_results(records: DataFrame, analyses: DataFrame, likes: DataFrame, strict: bool = False) -> DataFrame:
    """Records with both branches attached; a branch without a row becomes a FAILED default.

    Columns: every non-payload column of ``records`` (such as ``ord`` and ``run_id``), then paper,
    likes, analysis, status, warnings. ``strict`` runs the integrity report first and raises.
    """
    keys = _shared_keys(records, analyses, likes)
    if strict:
        require_integrity(records, analyses, likes, *keys)
    payload = [c for c in RECORD_TASK.names if c in records.columns]
    carried = [c for c in records.columns if c not in payload]
    papers = records.select("paper_key", *carried, F.struct(*payload).alias("paper"))
    key = F.col("paper.paper_key")
    found_analysis = analyses.select(
        *keys,
        F.col("status").alias("_a_status"),
        F.col("error_code").alias("_a_code"),
        "analysis",
    )
    found_likes = likes.select(*keys, F.struct(*LIKES_RESULT.names).alias("_likes"))
    joined = papers.join(found_analysis, keys, "left").join(found_likes, keys, "left")
    no_likes = F.struct(
        key.alias("paper_key"),
        F.col("paper.arxiv_id").alias("arxiv_id"),
        F.lit(None).cast("bigint").alias("likes"),
        F.lit(None).cast("string").alias("raw_text"),
        F.lit(V.FAILED).alias("status"),
        F.lit(V.MISSING_LIKES).alias("error_code"),
    )
    attached = joined.withColumn("likes", F.coalesce("_likes", no_likes))
    missing = F.col("_a_status").isNull()
    analysis_code = F.when(missing, F.lit(V.MISSING_ANALYSIS)).otherwise(F.col("_a_code"))
    likes_ok = F.col("likes.status") == V.SUCCESS
    analysis_ok = F.coalesce(F.col("_a_status") == V.SUCCESS, F.lit(False))
    return attached.select(
        *carried,
        "paper",
        "likes",
        F.when(~missing, F.col("analysis")).alias("analysis"),
        outcome(likes_ok, analysis_ok).alias("status"),
        F.array_compact(F.array(F.col("likes.error_code"), analysis_code)).alias("warnings"),
    )


def usable_answer(raw_answer: Column) -> Column:
    """A non-blank answer that does not echo the source envelope."""
    return F.coalesce(
        (strip(raw_answer) != "") & ~F.contains(fold_case(raw_answer), F.lit("<paper")), F.lit(False)
    )


def resume_analyses(tasks: DataFrame, logged: DataFrame, mode: str) -> DataFrame:
    """Tasks with ``done``: whether the latest logged analysis may be reused, and that row as ``previous``.

    Reusable means SUCCESS, same mode, same questions and (except in report mode) a usable answer.
    ``logged`` holds one row per key.
    """
    previous = logged.select(*_shared_keys(tasks, logged), F.struct(*logged.columns).alias("previous"))
    same = (
        (F.col("previous.status") == V.SUCCESS)
        & F.col("previous.analysis_mode").eqNullSafe(F.lit(mode))
        & F.col("previous.questions").eqNullSafe(F.col("questions"))
    )
    if mode != V.REPORT_MODE:
        same = same & usable_answer(F.col("previous.analysis.raw_answer"))
    return _resumed(tasks, previous, same)


def resume_likes(tasks: DataFrame, logged: DataFrame) -> DataFrame:
    """Tasks with ``done``: the latest logged likes are SUCCESS for the same id."""
    previous = logged.select(*_shared_keys(tasks, logged), F.struct(*logged.columns).alias("previous"))
    same = (F.col("previous.status") == V.SUCCESS) & (F.col("previous.arxiv_id") == F.col("arxiv_id"))
    return _resumed(tasks, previous, same)


def _resumed(tasks: DataFrame, previous: DataFrame, same: Column) -> DataFrame:
    done = F.coalesce(same, F.lit(False))
    joined = tasks.join(previous, _shared_keys(tasks, previous), "left").withColumn("done", done)
    return joined.withColumn("previous", F.when(F.col("done"), F.col("previous")))


def without_done(tasks: DataFrame, logged: DataFrame, key: str, is_done: Column) -> DataFrame:
    """Anti join form: rows of ``tasks`` whose key has no finished row in ``logged`` (one row per key)."""
    return tasks.join(logged.filter(is_done).select(key), key, "left_anti")


def merge_by_priority(parts: list[DataFrame], inputs: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """One row per input key from the last part that has it; parts go from lowest to highest priority.

    Columns a part lacks become NULL. Rows come back with the input's order column. The priority of a key is settled
    first on the key columns alone, so no wide row is sorted or aggregated.
    """
    ranked = [part.withColumn("_priority", F.lit(rank)) for rank, part in enumerate(parts)]
    stacked = ranked[0]
    for part in ranked[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    fields = [c for c in stacked.columns if c not in (*keys, "_priority", order)]
    best = stacked.groupBy(*keys).agg(F.max("_priority").alias("_priority"))
    rows = stacked.join(best, [*keys, "_priority"]).select(*keys, *fields)
    return inputs.select(*keys, order).join(rows, list(keys)).select(*keys, order, *fields)
