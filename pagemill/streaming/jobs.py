"""Batch jobs as micro-batches: discovery and recognition of new files, live counts, retries as state, control."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.schema import COMPLETED, FAILED, QUEUED, RETRYING, JobOptions


@dataclass
class JobControl:
    """Pause, resume, cancel and reconfigure a running job. Changes hold from the next micro-batch on; the one in flight finishes."""

    options: JobOptions = field(default_factory=JobOptions)
    status: str = "IDLE"
    _gate: threading.Event = field(default_factory=threading.Event)
    _query: StreamingQuery | None = None

    def __post_init__(self) -> None:
        self._gate.set()

    def attach(self, query: StreamingQuery) -> None:
        self._query, self.status = query, "RUNNING"

    def wait(self) -> None:
        self._gate.wait()

    def pause(self) -> None:
        if self.status == "RUNNING":
            self._gate.clear()
            self.status = "PAUSED"

    def resume(self) -> None:
        if self.status == "PAUSED":
            self.status = "RUNNING"
            self._gate.set()

    def cancel(self) -> None:
        self.status = "CANCELLED"
        self._gate.set()
        if self._query is not None:
            self._query.stop()

    def reconfigure(self, workers: int | None = None, output_format: str | None = None, retries: int | None = None) -> None:
        changes = {k: v for k, v in (("workers", workers), ("output_format", output_format), ("retries", retries)) if v is not None}
        if "workers" in changes and changes["workers"] < 1:
            raise ValueError("workers must be at least 1")
        self.options = replace(self.options, **changes)


def run_job(stream: DataFrame, work: Callable[[DataFrame, JobOptions], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, control: JobControl | None = None) -> StreamingQuery:
    """Work through what a stream has now, micro-batch by micro-batch, then stop; restarting goes on where it ended.

    Each batch is repartitioned to the workers in force, worked on once and handed to ``sink`` with its number,
    which makes writes repeatable. A paused job waits before its next batch.
    """
    control = control or JobControl()

    def batch(df: DataFrame, number: int) -> None:
        control.wait()
        if control.status != "CANCELLED":
            sink(work(df.repartition(control.options.workers), control.options), number)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    control.attach(query)
    return query


def status_counts(events: DataFrame, status: str = "status") -> DataFrame:
    """Events by state; as a stream in complete mode, the state is one row per state."""
    return events.groupBy(status).agg(F.count("*").alias("n"))


def new_lines(log: DataFrame, sequence: str, seen: Column | int) -> DataFrame:
    """The lines past what a client has seen: sequence numbers never repeat, so no line is lost or sent twice."""
    return log.where(F.col(sequence) > seen)


ATTEMPTS = "task_id long, status string, retries int, error string"


def retry_states(attempts: DataFrame, max_retries: int = 2) -> DataFrame:
    """The state of each task after its attempts so far, (task_id, ok, error, seq), from a stream; state is kept by task.

    A failed attempt queues the task again until its retries are used up; a later success keeps the last retry's
    message; a failure keeps the plain error.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, retries, error = state.get if state.exists else (QUEUED, 0, "")
        rows = pd.concat(list(frames)).sort_values("seq")
        for ok, message in zip(rows["ok"], rows["error"], strict=True):
            if status in (COMPLETED, FAILED):
                break
            if ok:
                status = COMPLETED
            elif retries < max_retries:
                retries, status = retries + 1, RETRYING
                error = f"Retrying attempt {retries}/{max_retries}: {message or 'Unknown error'}"
            else:
                status, error = FAILED, message
        state.update((status, retries, error))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "retries": [retries], "error": [error or None]})

    return attempts.groupBy("task_id").applyInPandasWithState(step, ATTEMPTS, "status string, retries int, error string", "update", GroupStateTimeout.NoTimeout)


def file_stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream of path, length and content; ordinary names only, as Spark's own source has it."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
