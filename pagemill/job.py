"""A running batch job: waves of tasks with control, live metrics, callbacks, logs and a dashboard.

Tasks are a table. A wave of them is one Spark job: read, render, recognise, export; between waves the job waits
while it is paused, ends when it is cancelled, and takes up changed options. What a wave has done is written
before the next begins, so metrics and callbacks speak of finished work.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import hardware, http
from pagemill.functions import text
from pagemill.operators import export, pages, recognise, tasks
from pagemill.schema import COMPLETED, FAILED, JobOptions
from pagemill.sources import files, kinds, sinks
from pagemill.streaming.jobs import JobControl

Callback = Callable[[dict], None]
#: Tasks of a wave, and tasks that the dashboard lists.
WAVE, LISTED = 10_000, 500


def lines(df: DataFrame) -> DataFrame:
    """``df`` with the lines of its ``content`` as ``pages``."""
    return df.withColumn("pages", F.split(F.decode("content", "UTF-8"), "\n"))


class BatchJob:
    """One job over ``sources``. ``run`` blocks until it has ended and returns the task table; the rest may be called meanwhile."""

    def __init__(
        self, spark: SparkSession, sources: str | list[str], options: JobOptions | None = None, pager: Callable[[DataFrame], DataFrame] | None = None, factory: Callable[[], recognise.Recogniser] = recognise.EchoRecogniser,
        on_complete: Callback | None = None, on_failed: Callback | None = None, per_wave: int = WAVE,
    ):
        self.spark, self.sources, self.pager, self.factory, self.per_wave = spark, sources, pager or lines, factory, per_wave
        self.on_complete, self.on_failed = on_complete, on_failed
        self.control, self.log = JobControl(options or JobOptions()), http.LogBuffer()
        self.total = 0
        self._began = self._ended = 0.0
        self._counts = {COMPLETED: 0, FAILED: 0}
        self._latest: list[dict] = []
        self._again = threading.Event()
        self._lock = threading.Lock()
        self.server = None

    # ---- control and observation

    @property
    def options(self) -> JobOptions:
        return self.control.options

    def pause(self) -> None:
        self.control.pause()
        self.log.add("Job paused")

    def resume(self) -> None:
        self.control.resume()
        self.log.add("Job resumed")

    def cancel(self) -> None:
        self.control.cancel()
        self.log.add("Job cancelled")

    def reconfigure(self, workers: int | None = None, output_format: str | None = None, retries: int | None = None) -> None:
        self.control.reconfigure(workers, output_format, retries)
        self.log.add("Job reconfigured")

    def retry_failed(self) -> int:
        """Queue the failed tasks once more, after the waves that are left; how many they are."""
        with self._lock:
            n = self._counts[FAILED]
            if n:
                self._again.set()
        return n

    def _busy(self) -> int:
        """Tasks that executors work on just now, no more than there are workers."""
        tracker = self.spark.sparkContext.statusTracker()
        running = (tracker.getStageInfo(s) for s in tracker.getActiveStageIds())
        return min(self.options.workers, sum(s.numActiveTasks for s in running if s)) if self.control.status == "RUNNING" else 0

    def metrics(self) -> dict:
        """The fields of schema.METRICS as they are now."""
        with self._lock:
            done, failed = self._counts[COMPLETED], self._counts[FAILED]
        elapsed = (self._ended or time.time()) - self._began if self._began else 0.0
        speed = done / elapsed if done and elapsed > 0 else 0.0
        left = self.total - done - failed
        return {
            "status": self.control.status, "total_files": self.total, "processed_files": done, "failed_files": failed, "queued_files": left, "active_workers": self._busy(), "target_workers": self.options.workers,
            "processing_speed_fps": round(speed, 2), "elapsed_time_sec": round(elapsed, 1), "eta_sec": round(left / speed, 1) if speed else 0.0,
            **hardware.gauges(), "model_id": self.options.model_id, "output_format": self.options.output_format,
        }

    def tasks(self) -> list[dict]:
        """The newest finished tasks, projected; at most LISTED."""
        with self._lock:
            return list(self._latest)

    # ---- work

    def run(self) -> DataFrame:
        """Work through all tasks. With nothing to do, or when cancelled before the first wave, the table is empty and no manifest is written."""
        options = self.options
        self._began, self.control.status = time.time(), "RUNNING"
        if options.enable_dashboard:
            self.server = http.serve(self, self.metrics, self.tasks, self.log, self.retry_failed, options.dashboard_host, options.dashboard_port)
        try:
            table = self._work(f"{options.output_dir.rstrip('/')}/_results")
            if self.control.status != "CANCELLED":
                self.control.status = COMPLETED
            return table
        except Exception:
            self.control.status = FAILED
            raise
        finally:
            self._ended = time.time()
            if self.server is not None:
                self.server.stopped.set()
                self.server.shutdown()
                self.server.server_close()

    @property
    def status(self) -> str:
        return self.control.status

    def _work(self, work: str) -> DataFrame:
        spark = self.spark
        empty = spark.createDataFrame([], "task_id string, source_path string, status string")
        found = files.discover(spark, self.sources, self.options.recursive)
        if found.isEmpty():
            self.log.add("Discovered 0 files")
            return empty
        queue = kinds.numbered(found).select(F.sha2("path", 256).alias("task_id"), "path", F.floor((F.col("ordinal") - 1) / self.per_wave).cast("int").alias("wave"), F.lit(time.time()).alias("created_at"))
        queue.write.mode("overwrite").partitionBy("wave").parquet(f"{work}/queue")
        queue = spark.read.schema("task_id string, path string, created_at double, wave int").parquet(f"{work}/queue")
        self.total = queue.count()
        self.log.add(f"Discovered {self.total} files")
        waves, last = 0, (self.total - 1) // self.per_wave
        done: list[str] = []
        while waves <= last or self._again.is_set():
            self.control.wait()
            if self.control.status == "CANCELLED":
                break
            if waves <= last:
                own = queue.where(F.col("wave") == waves).drop("wave")
            else:  # what had failed by then, once more
                self._again.clear()
                failed = self._table(done).where(F.col("status") == FAILED)
                own = failed.select("task_id", F.col("source_path").alias("path"), "created_at")
                with self._lock:
                    self._counts[FAILED] = 0
            done.append(self._wave(own, waves, work))
            waves += 1
        if not done:
            return empty
        table = self._table(done)
        summary = tasks.manifest_summary(table, time.time() - self._began, self.options.model_id).withColumn("timestamp", text.format_epoch(F.lit(time.time())))
        sinks.write_manifest(summary, tasks.task_projection(table).orderBy(F.split("source_path", "/")), self.options.output_dir)
        self.log.add("Manifest written")
        return table

    def _table(self, done: list[str]) -> DataFrame:
        """The latest state of every task."""
        rows = self.spark.read.parquet(*done)
        return tasks.last_writer(rows, "task_id", F.col("number")).drop("number")

    def _wave(self, own: DataFrame, number: int, work: str) -> str:
        """Recognise and export a wave's tasks; the folder that has their final rows."""
        options = self.options
        self.log.add(f"Wave {number}: processing with {options.workers} workers")
        # that many tasks at a time, whatever the cluster has
        paged = self.pager(files.read_content(own.repartition(options.workers))).select("task_id", F.col("path").alias("source_path"), "created_at", F.col("error").alias("read_error"), "pages")
        read = recognise.recognise_documents(paged, "pages", self.factory, options.retries, options.prompt, key=f"{self.factory.__module__}.{self.factory.__qualname__}-{options.model_id}-{options.device}", max_new_tokens=options.max_new_tokens)
        rows = read.select(
            "task_id", "source_path", F.when(F.col("read_error").isNotNull(), FAILED).otherwise(F.col("status")).alias("status"), "retries", F.lit(options.retries).alias("max_retries"), "created_at", "started_at", "completed_at",
            "duration_sec", F.coalesce("read_error", "error").alias("error"), pages.assembled(F.col("texts")).alias("result_text"), F.size("texts").alias("page_count"), F.lit(number).alias("number"),
        )
        raw, final = f"{work}/raw/{number}", f"{work}/tasks/{number}"
        rows.write.mode("overwrite").parquet(raw)
        rows = self.spark.read.parquet(raw)
        fmt = options.output_format.lower().strip()
        c, done = F.col, rows.where(F.col("status") == COMPLETED)
        body = export.rendered(F.lit(fmt), c("task_id"), c("source_path"), F.lit(options.model_id), c("duration_sec"), c("page_count"), c("completed_at"), c("result_text"))
        written = sinks.write_documents(done.select("task_id", text.output_name(c("source_path"), F.lit(fmt)).alias("output_name"), body.alias("body")), options.output_dir)
        written.write.mode("overwrite").parquet(f"{work}/paths/{number}")
        paths = self.spark.read.parquet(f"{work}/paths/{number}").withColumnRenamed("error", "export_error")
        table = rows.join(paths, "task_id", "left").withColumn("error", F.coalesce("export_error", "error")).drop("export_error")
        table.write.mode("overwrite").parquet(final)
        self._finished(self.spark.read.parquet(final))
        return final

    def _finished(self, wave: DataFrame) -> None:
        """Count a wave, keep its newest tasks for the dashboard, and call back for each task if anybody listens."""
        counts = {r.status: r.n for r in wave.groupBy("status").agg(F.count("*").alias("n")).collect()}
        newest = [r.asDict() for r in tasks.task_projection(wave).orderBy(F.desc("completed_at")).limit(LISTED).collect()]
        with self._lock:
            for state in self._counts:
                self._counts[state] += counts.get(state, 0)
            self._latest = (newest + self._latest)[:LISTED]
        self.log.add(f"Done: {counts.get(COMPLETED, 0)} completed, {counts.get(FAILED, 0)} failed")
        if self.on_complete or self.on_failed:
            for row in tasks.task_projection(wave).toLocalIterator():
                call = self.on_complete if row.status == COMPLETED else self.on_failed
                if call:
                    try:
                        call(row.asDict())
                    except Exception as e:  # a listener's failure isn't the job's
                        self.log.add(f"Callback error: {e}")

