"""A first-in, first-out queue of tasks in memory, for threads that feed or watch a job; a job's own tasks are a table."""

from __future__ import annotations

import threading
from collections import deque
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from pagemill.schema import COMPLETED, FAILED, PROCESSING, QUEUED, RETRYING


@dataclass(frozen=True)
class Task:
    """A task's state; a change is a new task of the same id."""

    task_id: str
    source_path: str
    status: str = QUEUED
    retries: int = 0
    max_retries: int = 2
    error: str | None = None


class Queue(Protocol):
    """What a queue has to offer; any store with these calls will do."""

    def enqueue(self, task: Task) -> None: ...

    def dequeue(self, timeout: float | None = None) -> Task | None: ...

    def task_done(self, task: Task) -> None: ...

    def requeue_failed(self, task: Task) -> bool: ...

    def size(self) -> int: ...

    def clear(self) -> None: ...

    def get_all_tasks(self) -> list[Task]: ...

    def get_task(self, task_id: str) -> Task | None: ...


@dataclass
class MemoryQueue:
    """``Queue`` for threads of one process."""

    _waiting: deque[str] = field(default_factory=deque)
    _tasks: dict[str, Task] = field(default_factory=dict)
    _changed: threading.Condition = field(default_factory=threading.Condition)

    def enqueue(self, task: Task) -> None:
        with self._changed:
            self._tasks[task.task_id] = replace(task, status=QUEUED)
            self._waiting.append(task.task_id)
            self._changed.notify()

    def dequeue(self, timeout: float | None = None) -> Task | None:
        """The task that has waited longest, now in progress; None if none comes in ``timeout`` seconds (None: at once)."""
        with self._changed:
            if not self._changed.wait_for(lambda: self._waiting, timeout or 0):
                return None
            task = replace(self._tasks[self._waiting.popleft()], status=PROCESSING)
            self._tasks[task.task_id] = task
            return task

    def task_done(self, task: Task) -> None:
        with self._changed:
            self._tasks[task.task_id] = replace(task, status=COMPLETED)

    def requeue_failed(self, task: Task) -> bool:
        """Whether the failed task waits again; with its retries used up it has failed for good."""
        with self._changed:
            again = task.retries < task.max_retries
            if again:
                n = task.retries + 1
                self._tasks[task.task_id] = replace(task, status=RETRYING, retries=n, error=f"Retrying attempt {n}/{task.max_retries}: {task.error or 'Unknown error'}")
                self._waiting.append(task.task_id)
                self._changed.notify()
            else:
                self._tasks[task.task_id] = replace(task, status=FAILED)
            return again

    def size(self) -> int:
        """Tasks that wait."""
        with self._changed:
            return len(self._waiting)

    def clear(self) -> None:
        """Nothing waits any more; what was known of the tasks goes too."""
        with self._changed:
            self._waiting.clear()
            self._tasks.clear()

    def get_all_tasks(self) -> list[Task]:
        with self._changed:
            return list(self._tasks.values())

    def get_task(self, task_id: str) -> Task | None:
        with self._changed:
            return self._tasks.get(task_id)


def as_table(spark: SparkSession, queue: Queue) -> DataFrame:
    """The queue's tasks, in the order they came, as rows that the task operators take."""
    rows = [(k, t.task_id, t.source_path, t.status, t.retries, t.max_retries, t.error) for k, t in enumerate(queue.get_all_tasks())]
    return spark.createDataFrame(rows, "ordinal int, task_id string, source_path string, status string, retries int, max_retries int, error string")
