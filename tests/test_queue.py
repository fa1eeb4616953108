"""The task queue's contract."""

import threading
import time

from pagemill.operators import tasks
from pagemill.operators.queue import MemoryQueue, Task, as_table


def test_first_in_first_out():
    q = MemoryQueue()
    for k in range(3):
        q.enqueue(Task(str(k), f"{k}.png"))
    assert q.size() == 3
    got = [q.dequeue() for _ in range(3)]
    assert [t.task_id for t in got] == ["0", "1", "2"] and {t.status for t in got} == {"PROCESSING"}
    assert q.size() == 0 and q.dequeue() is None and q.dequeue(timeout=0.05) is None


def test_states_and_retries():
    q = MemoryQueue()
    q.enqueue(Task("a", "a.png", max_retries=1))
    q.enqueue(Task("b", "b.png"))
    a, b = q.dequeue(), q.dequeue()
    q.task_done(b)
    assert q.get_task("b").status == "COMPLETED" and q.get_task("none") is None
    assert q.requeue_failed(a) and q.get_task("a").status == "RETRYING" and q.get_task("a").error == "Retrying attempt 1/1: Unknown error"
    assert not q.requeue_failed(q.dequeue()) and q.get_task("a").status == "FAILED" and q.size() == 0
    assert len(q.get_all_tasks()) == 2
    q.clear()
    assert q.get_all_tasks() == [] and q.size() == 0


def test_many_threads():
    q, got = MemoryQueue(), []

    def feed(n):
        for i in range(50):
            q.enqueue(Task(f"{n}-{i}", "f.png"))

    def take():
        while (t := q.dequeue(timeout=0.5)) is not None:
            got.append(t.task_id)

    threads = [threading.Thread(target=feed, args=(n,)) for n in range(4)] + [threading.Thread(target=take) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == len(set(got)) == 200


def test_a_waiting_reader_is_woken():
    q, got = MemoryQueue(), []
    reader = threading.Thread(target=lambda: got.append(q.dequeue(timeout=10)))
    reader.start()
    time.sleep(0.1)
    began = time.monotonic()
    q.enqueue(Task("x", "x.png"))
    reader.join()
    assert got[0].task_id == "x" and time.monotonic() - began < 5


def test_as_a_table(spark):
    q = MemoryQueue()
    for k in range(4):
        q.enqueue(Task(str(k), f"{k}.png", max_retries=0))
    q.task_done(q.dequeue())
    q.requeue_failed(q.dequeue())
    table = as_table(spark, q)
    assert [r.status for r in table.orderBy("ordinal").collect()] == ["COMPLETED", "FAILED", "QUEUED", "QUEUED"]
    assert tasks.pending(table).count() == 2 and tasks.retry_failed(table).where("status = 'QUEUED'").count() == 3
