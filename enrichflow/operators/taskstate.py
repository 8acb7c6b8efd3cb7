"""Task queue semantics as folds over an event log: insert, next, state machine, terminal results.

An event is (run_id, seq, kind, paper_key, title, arxiv_url, arxiv_id, likes, raw_text, error_code)
with kind one of enqueue, claim, success, failure; ``seq`` is unique. Folds are chains of keyed minimum
aggregates, so a key with very many events is cut down inside each input task.
"""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from enrichflow.operators.counts import state_histogram
from enrichflow.sources.scratch import written

ENQUEUE, CLAIM, RESULT_OK, RESULT_BAD = "enqueue", "claim", "success", "failure"
KEYS = ("run_id", "paper_key")
IDENTITY = ("title", "arxiv_url", "arxiv_id")

_BLOCK_BITS = 20  # a block is 2**20 sequence numbers: bounds the events of one key that meet in a join

UNKNOWN_TASK, OTHER_IDENTITY = "UNKNOWN_TASK", "OTHER_IDENTITY"
ALREADY_SUCCEEDED, NOT_CLAIMED, NOT_PENDING = "ALREADY_SUCCEEDED", "NOT_CLAIMED", "NOT_PENDING"


def insert_tasks(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per (key, identity) offered: inserted, existing or conflicting row counts.

    The stored identity wins, else the first offered one. Copies collapse to distinct identities
    before keys meet, so repeats of a task cost nothing after the first shuffle.
    """
    identity = F.struct(*IDENTITY)
    old = stored.select(*keys, identity.alias("identity"), F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("offer"))
    new = incoming.select(*keys, identity.alias("identity"), F.col("seq"), F.lit(1).alias("offer"))
    offers = (
        old.unionByName(new)
        .groupBy(*keys, "identity")
        .agg(F.min("seq").alias("first_seq"), F.sum("offer").alias("offered"))
    )
    owner = offers.groupBy(*keys).agg(
        F.min_by("identity", "first_seq").alias("owner"), F.min("first_seq").alias("owner_seq")
    )
    same = F.col("identity").eqNullSafe(F.col("owner"))
    inserted = F.when(same & (F.col("owner_seq") >= 0), 1).otherwise(0)
    return (
        offers.join(owner, list(keys))
        .filter(F.col("offered") > 0)
        .select(
            *keys,
            "identity.*",
            F.col("first_seq").alias("seq"),
            inserted.cast("bigint").alias("inserted"),
            F.when(same, F.col("offered") - inserted).otherwise(0).cast("bigint").alias("existing"),
            F.when(same, 0).otherwise(F.col("offered")).cast("bigint").alias("conflicts"),
        )
    )


def insert_counts(inserts: DataFrame, *groups: str) -> DataFrame:
    return inserts.groupBy(*groups).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("inserted", "existing", "conflicts"))
    )


def pending_rows(inserts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows to add to the task table: none of a run whose batch conflicts with a stored or earlier identity anywhere."""
    clash = inserts.filter("conflicts > 0").select("run_id").distinct()
    return inserts.filter("inserted > 0").join(clash, "run_id", "left_anti").select(
        *keys, *IDENTITY, "seq", F.lit("PENDING").alias("state"), F.lit(0).alias("attempts")
    )


def next_pending(tasks: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """Per run the first PENDING task in sequence order, with its attempt number."""
    waiting = tasks.filter(F.col("state") == "PENDING")
    fields = [c for c in waiting.columns if c != run]
    picked = waiting.groupBy(run).agg(F.min_by(F.struct(*fields), order).alias("task")).select(run, "task.*")
    return picked.withColumn("attempts", F.col("attempts") + 1).withColumn("state", F.lit("CLAIMED"))


def _first_after(events: DataFrame, anchors: DataFrame, keys: list[str], after: str, into: str) -> DataFrame:
    """Per key the first event (as a struct) with a sequence number above the anchor's ``after``.

    ``anchors`` has one row per key. Events are cut into sequence blocks. Each block gives its first event, and the
    anchor's own block its first one above the anchor, in one pass over the events whose join and reduction share a
    shuffle by key and block. So a key with very many events never meets its anchor in one task.
    """
    fields = [c for c in events.columns if c not in keys]
    row = F.struct(*fields)
    cut = anchors.select(*keys, F.col(after).alias("_after"), F.shiftright(after, _BLOCK_BITS).alias("_block"))
    blocked = events.withColumn("_block", F.shiftright("seq", _BLOCK_BITS)).join(cut, [*keys, "_block"], "left")
    late = F.col("_after").isNull() | (F.col("seq") > F.col("_after"))
    firsts = blocked.groupBy(*keys, "_block").agg(F.min_by(row, F.when(late, F.col("seq"))).alias(into)).filter(F.col(into).isNotNull())
    met = firsts.join(cut.drop("_after").withColumnRenamed("_block", "_own"), keys).filter(F.col("_block") >= F.col("_own"))
    return met.groupBy(*keys).agg(F.min_by(into, f"{into}.seq").alias(into))


def fold_states(events: DataFrame, keys: Sequence[str] = KEYS, carry: Sequence[str] = IDENTITY) -> DataFrame:
    """Current task table from the log: first enqueue, first claim after it, first result after that.

    A result counts only when its id is the enqueued one. Enqueued and claimed tasks are stored on the way, so
    the log is read three times in all.
    """
    keys = list(keys)
    enqueued = written(
        events.filter(F.col("kind") == ENQUEUE)
        .groupBy(*keys)
        .agg(F.min_by(F.struct("seq", *carry), "seq").alias("_task"))
    )
    anchors = enqueued.select(*keys, F.col("_task.seq").alias("seq"), F.col("_task.arxiv_id").alias("arxiv_id"))
    claims = events.filter(F.col("kind") == CLAIM).select(*keys, "seq")
    claimed = written(_first_after(claims, anchors, keys, "seq", "_claim"))
    results = events.filter(F.col("kind").isin(RESULT_OK, RESULT_BAD)).select(
        *keys, "arxiv_id", "seq", "kind", "likes", "raw_text", "error_code"
    )
    open_tasks = anchors.drop("seq").join(claimed, keys).select(*keys, "arxiv_id", F.col("_claim.seq").alias("claimed_seq"))
    finished = _first_after(results, open_tasks, [*keys, "arxiv_id"], "claimed_seq", "_result").drop("arxiv_id")
    state = (
        F.when(F.col("_result.kind") == RESULT_OK, F.lit("SUCCESS"))
        .when(F.col("_result.kind") == RESULT_BAD, F.lit("FAILED"))
        .when(F.col("_claim").isNotNull(), F.lit("CLAIMED"))
        .otherwise(F.lit("PENDING"))
    )
    return (
        enqueued.join(claimed, keys, "left")
        .join(finished, keys, "left")
        .select(
            *keys,
            *(F.col(f"_task.{c}").alias(c) for c in carry),
            state.alias("state"),
            F.col("_claim").isNotNull().cast("int").alias("attempts"),
            "_result.likes",
            "_result.raw_text",
            "_result.error_code",
            F.col("_task.seq").alias("seq"),
            F.col("_claim.seq").alias("claimed_seq"),
            F.col("_result.seq").alias("result_seq"),
        )
    )


def refusal(event_seq: Column, kind: Column, same_id: Column) -> Column:
    """Why an event did not move its task (NULL when it did, or for a repeated enqueue)."""
    before_enqueue = F.col("enqueued_seq").isNull() | (event_seq < F.col("enqueued_seq"))
    finished = F.coalesce(event_seq > F.col("result_seq"), F.lit(False))
    unclaimed = F.col("claimed_seq").isNull() | (event_seq < F.col("claimed_seq"))
    is_result = kind.isin(RESULT_OK, RESULT_BAD)
    accepted = F.coalesce(event_seq == F.col("claimed_seq"), F.lit(False)) | F.coalesce(
        event_seq == F.col("result_seq"), F.lit(False)
    )
    return (
        F.when(~kind.isin(CLAIM, RESULT_OK, RESULT_BAD), F.lit(None).cast("string"))
        .when(accepted, F.lit(None).cast("string"))
        .when(before_enqueue, F.lit(UNKNOWN_TASK))
        .when(is_result & ~same_id, F.lit(OTHER_IDENTITY))
        .when(is_result & finished & (F.col("state") == "SUCCESS"), F.lit(ALREADY_SUCCEEDED))
        .when(is_result & (finished | unclaimed), F.lit(NOT_CLAIMED))
        .when(kind == CLAIM, F.lit(NOT_PENDING))
    )


def audit_rows(events: DataFrame, folded: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Events that were refused, with the reason."""
    state = folded.select(
        *keys,
        F.col("seq").alias("enqueued_seq"),
        "claimed_seq",
        "result_seq",
        "state",
        F.col("arxiv_id").alias("_own_id"),
    )
    joined = events.select(*keys, "seq", "kind", "arxiv_id").join(state, list(keys), "left")
    same_id = F.col("arxiv_id").eqNullSafe(F.col("_own_id"))
    return (
        joined.withColumn("reason", refusal(F.col("seq"), F.col("kind"), same_id))
        .filter(F.col("reason").isNotNull())
        .select(*keys, "seq", "kind", "reason")
    )


def terminal_results(tasks: DataFrame, *groups: str) -> DataFrame:
    """Finished tasks; sequence order is carried in ``seq``."""
    return tasks.filter(F.col("state").isin("SUCCESS", "FAILED")).select(
        *groups, "seq", "paper_key", "arxiv_id", "likes", "raw_text", F.col("state").alias("status"), "error_code"
    )


def run_states(tasks: DataFrame, run: str = "run_id") -> DataFrame:
    return state_histogram(tasks, [run])


def stuck_claims(tasks: DataFrame, run: str = "run_id") -> DataFrame:
    """Claims without a result: a claimed task never goes back to pending."""
    return tasks.groupBy(run).agg(F.count_if(F.col("state") == "CLAIMED").alias("stuck"))
