"""Stand-ins: the supplied tables in the roles of files, pages, tasks, events and machines, and the same in DuckDB SQL.

No image or PDF is at hand, so texts play pages: this exercises the operators' semantics, not recognition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The suffixes that stand-in files have, and the event types' states.
SUFFIXES = (".png", ".JPG", ".jpeg", ".webp", ".bmp", ".tiff", ".tif", ".pdf", ".PDF", ".txt", ".docx", "")
STATES = {"signup": "QUEUED", "view": "PROCESSING", "purchase": "COMPLETED", "error": "FAILED", "click": "RETRYING"}
EPOCH = 1_704_067_200
ELAPSED = 137.5

SQL_SUFFIXES = "[" + ", ".join(f"'{s}'" for s in SUFFIXES) + "]"
SQL_PATH = f"'/' || lang || '/' || source || '/doc' || (doc_id % 97) || {SQL_SUFFIXES}[(doc_id % 12) + 1]"
SQL_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"
SQL_SUPPORTED = "lower(regexp_extract({p}, '[^/](\\.[^./]+)$', 1)) IN ('.png', '.jpg', '.jpeg', '.webp', '.bmp', '.tiff', '.tif', '.pdf')"
#: Tasks of the documents: f = doc_id % 5 attempts fail, two retries are allowed, durations have two decimals.
SQL_TASKS = f"""SELECT CAST(doc_id AS VARCHAR) AS task_id, {SQL_PATH} AS source_path,
  CASE WHEN doc_id % 5 <= 2 THEN 'COMPLETED' ELSE 'FAILED' END AS status, CAST(least(doc_id % 5, 2) AS INTEGER) AS retries, 2 AS max_retries,
  CAST({EPOCH} + doc_id AS DOUBLE) AS created_at, CAST({EPOCH} + doc_id AS DOUBLE) AS started_at, {EPOCH} + doc_id + (100 + doc_id % 1000) / 100.0::DOUBLE AS completed_at,
  (100 + doc_id % 1000) / 100.0::DOUBLE AS duration_sec,
  CASE WHEN doc_id % 5 > 2 THEN 'broken page' WHEN doc_id % 5 > 0 THEN 'Retrying attempt ' || (doc_id % 5) || '/2: broken page' END AS error,
  text AS result_text, CAST(NULL AS VARCHAR) AS output_path, CAST(len(string_split(text, chr(10))) AS INTEGER) AS page_count, doc_id, text FROM documents"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path() -> Column:
    ext = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 12 + 1).cast("int"))
    return F.concat(F.lit("/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc"), (F.col("doc_id") % 97).cast("string"), ext)


def pages() -> Column:
    return F.split("text", "\n")


def duration() -> Column:
    return (100 + F.col("doc_id") % 1000) / F.lit(100.0)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each document, after its retries."""
    from pagemill.operators.tasks import retry_outcome

    outcome = retry_outcome((F.col("doc_id") % 5).cast("int"), F.lit(2), F.lit("broken page"))
    rows = documents(spark, sf_dir).select("doc_id", "text", path().alias("source_path"), outcome.alias("o"), duration().alias("duration_sec"))
    created = (F.lit(EPOCH) + F.col("doc_id")).cast("double")
    return rows.select(
        F.col("doc_id").cast("string").alias("task_id"), "source_path", "o.status", "o.retries", F.lit(2).alias("max_retries"), created.alias("created_at"), created.alias("started_at"),
        (created + F.col("duration_sec")).alias("completed_at"), "duration_sec", "o.error", F.col("text").alias("result_text"), F.lit(None).cast("string").alias("output_path"), F.size(pages()).alias("page_count"), "doc_id", "text",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with task states."""
    state = None
    for k, v in STATES.items():
        state = (state.when if state is not None else F.when)(F.col("event_type") == k, v)
    return table(spark, sf_dir, "events").withColumn("status", state)
