"""The task table: states, retries, projections, manifests, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import file_name, json_text, preview
from pagemill.schema import COMPLETED, FAILED, PENDING, PROCESSING, QUEUED, JobOptions
from pagemill.sources.kinds import order_range


def latest_status(events: DataFrame, task: str, status: str, *order: str) -> DataFrame:
    """(task, status) after the last event of each task: a grouped maximum, combined before the shuffle."""
    return events.groupBy(task).agg(F.max(F.struct(*order, status)).getField(status).alias(status))


def pending(tasks: DataFrame, status: str = "status") -> DataFrame:
    return tasks.where(F.col(status).isin(*PENDING))


def retry_outcome(failures: Column, max_retries: Column, error: Column) -> Column:
    """struct(status, retries, error) of a task whose first ``failures`` attempts fail with ``error``."""
    retries = F.least(failures, max_retries)
    message = F.concat(F.lit("Retrying attempt "), retries.cast("string"), F.lit("/"), max_retries.cast("string"), F.lit(": "), F.coalesce(error, F.lit("Unknown error")))
    done = failures <= max_retries
    text = F.when(done & (failures > 0), message).when(~done, error)
    return F.struct(F.when(done, COMPLETED).otherwise(FAILED).alias("status"), retries.alias("retries"), text.alias("error"))


def retry_failed(tasks: DataFrame) -> DataFrame:
    """All tasks with the failed ones queued again: no retries, no error."""
    failed = F.col("status") == FAILED
    return tasks.withColumns(
        {
            "status": F.when(failed, QUEUED).otherwise(F.col("status")),
            "retries": F.when(failed, 0).otherwise(F.col("retries")),
            "error": F.when(failed, F.lit(None)).otherwise(F.col("error")),
        }
    )


def task_projection(tasks: DataFrame) -> DataFrame:
    """The 14 reported fields of a task."""
    return tasks.select(
        F.col("task_id").cast("string").alias("task_id"), "source_path", file_name(F.col("source_path")).alias("file_name"), "status", "retries", "max_retries", "created_at", "started_at", "completed_at",
        F.round("duration_sec", 3).alias("duration_sec"), "error", preview(F.col("result_text")).alias("result_text_preview"), "output_path", "page_count",
    )


def manifest_summary(tasks: DataFrame, elapsed: float, model_id: str) -> DataFrame:
    """One row: totals by state, elapsed time and speed."""
    done = F.count_if(F.col("status") == COMPLETED)
    return tasks.agg(
        F.count("*").alias("total_files"),
        done.alias("completed_files"),
        F.count_if(F.col("status") == FAILED).alias("failed_files"),
        F.round(F.lit(float(elapsed)), 2).alias("elapsed_time_sec"),
        F.round(done / F.lit(max(float(elapsed), 0.001)), 2).alias("average_speed_fps"),
        F.lit(model_id).alias("model_id"),
    )


def task_json(tasks: DataFrame) -> Column:
    """The JSON of a projected task row."""
    return json_text(F.struct(*tasks.columns))


def job_metrics(tasks: DataFrame, elapsed: float, state: str = "RUNNING", options: JobOptions = JobOptions(), gauges: dict | None = None) -> DataFrame:
    """One row with the fields of schema.METRICS: the job's state, counters, speed and time left, and the machine's ``gauges``.

    Speed and time left are 0 until something is done; tasks in progress are the active workers, each having one at a time.
    """
    done, failed, total = F.count_if(F.col("status") == COMPLETED), F.count_if(F.col("status") == FAILED), F.count("*")
    speed = done / F.lit(float(elapsed))
    working = (done > 0) & F.lit(elapsed > 0)
    gauges = gauges or {}
    gauge = lambda name, digits: F.round(F.lit(float(gauges.get(name) or 0.0)), digits).alias(name)
    return tasks.agg(
        F.lit(state).alias("status"),
        total.alias("total_files"),
        done.alias("processed_files"),
        failed.alias("failed_files"),
        F.count_if(F.col("status").isin(*PENDING)).alias("queued_files"),
        F.count_if(F.col("status") == PROCESSING).cast("int").alias("active_workers"),
        F.lit(options.workers).alias("target_workers"),
        F.round(F.when(working, speed).otherwise(F.lit(0.0)), 2).alias("processing_speed_fps"),
        F.round(F.lit(float(elapsed)), 1).alias("elapsed_time_sec"),
        F.round(F.when(working, (total - done - failed) / speed).otherwise(F.lit(0.0)), 1).alias("eta_sec"),
        gauge("cpu_percent", 1), gauge("ram_used_gb", 2), gauge("ram_total_gb", 2), gauge("vram_used_gb", 2), gauge("vram_total_gb", 2),
        F.lit(gauges.get("gpu_name")).cast("string").alias("gpu_name"),
        F.lit(options.model_id).alias("model_id"),
        F.lit(options.output_format).alias("output_format"),
    )


def used_percent(used: Column, total: Column) -> Column:
    """Share of memory in use, in percent; 0 where the total isn't known."""
    return F.round(F.when(total > 0, used / total * 100).otherwise(F.lit(0.0)), 1)


def prefix_totals(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Running totals in a global order without gathering it in one task.

    Running sums inside ranges of the order, about equally full ones, plus the total of the earlier ranges, which is
    a window over one small row a range.
    """
    ranged = df.withColumn("_range", order_range(df, *order))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_{k}") for k, v in values.items()])
    before = totals.select("_range", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in values])
    rows = ranged.withColumns({k: F.sum(v).over(inside) for k, v in values.items()}).join(before, "_range")
    return rows.withColumns({k: F.col(k) + F.col(f"_{k}") for k in values}).drop("_range", *[f"_{k}" for k in values])


def last_writer(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """The row that wins each output name: the last in ``order``. A grouped maximum, combined before the shuffle, so a name
    that many rows have isn't gathered."""
    last = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]))
    return df.groupBy(F.col(name).alias("_name")).agg(last.alias("_row")).select("_row.*")
