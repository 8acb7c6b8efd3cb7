"""Streaming forms: latest row per key, task states, reports. Each equals its batch operator.

State that must last is in keyed tables (``upserts``) or in Structured Streaming's state store; sinks write one directory per
micro-batch and overwrite it when a batch is replayed, so results do not change after a restart.
"""
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from enrichflow.fixed_values import COMPLETED
from enrichflow.operators import joins, reports, taskstate
from enrichflow.operators.keyed import last_per_key, protected_latest
from enrichflow.schemas import INT, LONG, TEXT, row
from enrichflow.streaming.upserts import KeyedTable, latest_by, start_each_batch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """Files in arrival order; the number per trigger bounds what one micro-batch can hold."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_sink(updates: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the rows changed by each micro-batch to ``path/batch_id=N``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        updates.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key written by ``start_sink``."""
    return last_per_key(spark.read.parquet(path), keys, ["batch_id"]).drop("batch_id")


def latest_table(root: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], status: str = "status",
                 final: str = COMPLETED, buckets: int = 64) -> KeyedTable:
    """Row-by-row upsert as a keyed table: finished rows stay, otherwise the newest row wins."""
    return KeyedTable(root, keys, schema, lambda rows: protected_latest(rows, keys, order, status, final), buckets)


def start_upserts(events: DataFrame, table: KeyedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep ``table`` up to date with a stream of its rows."""
    return start_each_batch(events, table.apply, checkpoint, **trigger)


def stream_latest(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], status: str = "status", final: str = COMPLETED
) -> DataFrame:
    """The same as a streaming aggregate, for sinks that take updated rows."""
    return protected_latest(events, keys, order, status, final)


_STEP = row(
    run_id=TEXT, paper_key=TEXT, seq=LONG, kind=TEXT, state=TEXT, attempts=INT, likes=LONG, raw_text=TEXT,
    error_code=TEXT, reason=TEXT,
)
_STATE = row(state=TEXT, arxiv_id=TEXT)


_EVENT = row(seq=LONG, kind=TEXT, arxiv_id=TEXT, likes=LONG, raw_text=TEXT, error_code=TEXT)
_RESULTS = (taskstate.RESULT_OK, taskstate.RESULT_BAD)
Event = tuple  # in the order of _EVENT; most tasks have few events in a batch, so they are plain tuples, not frames
Chunks = Callable[[], Iterable[Sequence[Event]]]
_NEVER = np.iinfo(np.int64).max


def _events(chunk: pd.DataFrame) -> list[Event]:
    columns = {name: chunk[name].tolist() for name in _EVENT.names}
    columns["likes"] = [None if pd.isna(v) else int(v) for v in columns["likes"]]
    return list(zip(*columns.values()))


def _earliest(chunks: Chunks, kinds: tuple[str, ...], after: int, own_id: str | None = None) -> tuple[int, Event | None]:
    """Smallest sequence number above ``after`` of the events of these kinds, results of this id only, and that event."""
    seq, found = _NEVER, None
    for chunk in chunks():
        for event in chunk:
            if after < event[0] < seq and event[1] in kinds and (kinds is not _RESULTS or own_id is not None and event[2] == own_id):
                seq, found = event[0], event
    return seq, found


def _moves(state: str | None, own_id: str | None, chunks: Chunks) -> tuple[str | None, list[tuple[int, str | None]]]:
    """Where a task moves within a micro-batch: its id, and (sequence number, state after it) for enqueue, claim and result.

    A task moves at most three times, so three searches over the chunks find all moves, in whatever order events come.
    """
    at, steps = -_NEVER, []
    if state is None:
        at, event = _earliest(chunks, (taskstate.ENQUEUE,), at)
        own_id, state = (event[2], "PENDING") if event is not None else (own_id, None)
        steps.append((at, "PENDING"))
    if state == "PENDING":
        at, event = _earliest(chunks, (taskstate.CLAIM,), at)
        state = "CLAIMED" if event is not None else state
        steps.append((at, "CLAIMED"))
    if state == "CLAIMED":
        at, event = _earliest(chunks, _RESULTS, at, own_id)
        if event is not None:
            steps.append((at, "SUCCESS" if event[1] == taskstate.RESULT_OK else "FAILED"))
    return own_id, steps


def _judged(key: tuple, state: str | None, own_id: str | None, moves: list[tuple[int, str | None]], chunk: Sequence[Event]) -> list[tuple]:
    """The events of a chunk that moved the task or were refused, in the order of ``_STEP``."""
    steps = []
    for seq, kind, arxiv_id, *found in chunk:
        before = after = state
        moved = False
        for at, to in moves:
            before = to if seq > at else before
            after = to if seq >= at else after
            moved |= seq == at
        if moved:
            reason = None
        elif kind == taskstate.ENQUEUE:
            continue
        elif before is None:
            reason = taskstate.UNKNOWN_TASK
        elif kind == taskstate.CLAIM:
            reason = taskstate.NOT_PENDING
        elif arxiv_id != own_id:
            reason = taskstate.OTHER_IDENTITY
        else:
            reason = taskstate.ALREADY_SUCCEEDED if before == "SUCCESS" else taskstate.NOT_CLAIMED
        finished = moved and kind in _RESULTS
        attempts = int(after in ("CLAIMED", "SUCCESS", "FAILED"))
        steps.append((*key, seq, kind, after, attempts, *(found if finished else (None, None, None)), reason))
    return steps


def _frame(steps: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(steps, columns=_STEP.names, dtype=object)
    return frame.astype({"seq": "int64", "attempts": "int32", "likes": "Int64"})


class TaskMachine(StatefulProcessor):
    """One task: its state and id are a value in the state store.

    A task whose events of a micro-batch fill more than one Arrow batch has them put into a list of the state store, and read from there
    chunk by chunk for each search; no frame holds them all.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("task", _STATE)
        self.many = handle.getListState("events", _EVENT)

    def _stored(self, size: int) -> Iterator[list[Event]]:
        held = (tuple(event) for event in self.many.get())
        while chunk := list(islice(held, size)):
            yield chunk

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, own_id = self.held.get() if self.held.exists() else (None, None)
        first, second = _events(next(rows)), next(rows, None)
        if second is None:
            def chunks():
                return [first]
        else:
            self.many.appendList(first)
            for chunk in chain([second], rows):
                self.many.appendList(_events(chunk))

            def chunks():
                return self._stored(len(first))
        own_id, moves = _moves(state, own_id, chunks)
        moves = [m for m in moves if m[0] != _NEVER]
        if moves:
            self.held.update((moves[-1][1], own_id))
        for chunk in chunks():
            if steps := _judged(key, state, own_id, moves, chunk):
                yield _frame(steps)
        if second is not None:
            self.many.clear()

    def close(self) -> None:
        pass


def stream_task_steps(events: DataFrame) -> DataFrame:
    """One row per event that moved a task or was refused (``reason``).

    Task states need the RocksDB state store, so the session's provider is set to it; a query that goes on from a checkpoint keeps its own.
    Events must arrive in sequence order between micro-batches; within one their order does not matter.
    """
    known = events.filter(
        F.col("kind").isin(taskstate.ENQUEUE, taskstate.CLAIM, taskstate.RESULT_OK, taskstate.RESULT_BAD)
    )
    slim = known.select("run_id", "paper_key", *_EVENT.names)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return slim.groupBy("run_id", "paper_key").transformWithStateInPandas(
        TaskMachine(), outputStructType=_STEP, outputMode="Update", timeMode="None"
    )


def states_from_steps(steps: DataFrame) -> DataFrame:
    """Current state per task out of the stream's step rows."""
    moved = steps.filter(F.col("reason").isNull())
    return last_per_key(moved.drop("reason", "kind"), ["run_id", "paper_key"], ["seq"])


def refused_from_steps(steps: DataFrame) -> DataFrame:
    return steps.filter(F.col("reason").isNotNull()).select("run_id", "paper_key", "seq", "kind", "reason")


class ReportFeed:
    """Reports of the papers that a micro-batch touches: interim while only the analysis is there, then final.

    ``branch_events``: (paper_key, seq, analysis_result struct or NULL, likes_result struct or NULL). The newest row of each branch
    is kept in a keyed table under ``root``, not in a state store. A batch updates both tables, and renders what it touched from the
    touched rows and a static table of records; ``reports`` holds the newest body of each paper.
    """

    def __init__(self, root: str, events: T.StructType, tasks: DataFrame, buckets: int = 64):
        self.tasks = tasks
        self.branches = {
            name: KeyedTable(f"{root}/{name}", ["paper_key"], T.StructType([events["paper_key"], events["seq"], events[name]]),
                             latest_by(["paper_key"], ["seq"]), buckets)
            for name in ("analysis_result", "likes_result")
        }
        shape = row(paper_key=TEXT, file_name=TEXT, body=TEXT, batch=LONG)
        self.reports = KeyedTable(f"{root}/reports", ["paper_key"], shape, latest_by(["paper_key"], ["batch"]), buckets)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            hit = self.reports.hit(batch)  # all three tables have the same key and buckets
            for name, table in self.branches.items():
                own = batch.filter(F.col(name).isNotNull())
                table.apply(own, batch_id, hit & table.hit(own))
            keys = batch.select("paper_key").distinct()
            found = [table.touched(keys, hit).select("paper_key", name) for name, table in self.branches.items()]
            made = self._rendered(found[0].join(found[1], "paper_key", "left"))
            self.reports.apply(made.withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id, hit)
        finally:
            batch.unpersist()

    def _rendered(self, both: DataFrame) -> DataFrame:
        papers = self.tasks.select("paper_key", F.struct("title", "arxiv_id", "questions").alias("paper"))
        likes, analysis = F.col("likes_result"), F.col("analysis_result.analysis")
        status = joins.outcome(F.col("likes_result.status") == "SUCCESS", F.col("analysis_result.status") == "SUCCESS")
        warnings = F.array_compact(F.array(F.col("likes_result.error_code"), F.col("analysis_result.error_code")))
        interim = reports.interim_report(F.col("paper"), analysis, F.col("analysis_result.error_code"))
        final = reports.final_report(F.col("paper"), likes, analysis, status, warnings)
        return both.join(papers, "paper_key").select(
            "paper_key",
            reports.report_name(F.col("paper.arxiv_id")).alias("file_name"),
            F.when(likes.isNull(), interim).otherwise(final).alias("body"),
        )


def start_reports(branch_events: DataFrame, feed: ReportFeed, checkpoint: str, **trigger) -> StreamingQuery:
    return start_each_batch(branch_events, feed.apply, checkpoint, **trigger)
