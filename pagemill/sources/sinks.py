"""Named files: one per document, and the job's manifest."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import json_text
from pagemill.operators.tasks import last_writer

MANIFEST = "batch_manifest.json"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def pretty(document: str) -> str:
    """JSON in two-space indentation, letters of any script as they are."""
    return json.dumps(json.loads(document), indent=2, ensure_ascii=False)


def write_documents(df: DataFrame, out_dir: str, name: str = "output_name", body: str = "body", key: str = "task_id", collisions: str = "disambiguate", order: str | None = None) -> DataFrame:
    """Write each row's body to ``out_dir``/name from the tasks; returns (key, output_path, error), lazily.

    ``collisions``: ``disambiguate`` puts the key into names that several rows have, ``overwrite`` keeps the last
    row in ``order``. A file is written under a temporary name and moved, so a repeated task leaves no half file.
    JSON documents are indented.
    """
    if collisions == "overwrite":
        rows = last_writer(df, name, F.col(order or key), F.col(key))
    else:
        taken = df.groupBy(name).agg((F.count("*") > 1).alias("_shared"))
        stem, ext = F.regexp_replace(F.col(name), r"\.[^.]+$", ""), F.regexp_extract(F.col(name), r"(\.[^.]+)$", 1)
        rows = df.join(taken, name).withColumn(name, F.when(F.col("_shared"), F.concat(stem, F.lit("-"), F.col(key).cast("string"), ext)).otherwise(F.col(name)))
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(name).alias("name"), F.col(body).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(out_dir)
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths, errors = [], []
            for k, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                final = f"{root}/{n}"
                try:
                    with store.open_output_stream(f"{final}.{k}.part") as f:
                        f.write((pretty(text) if n.endswith(".json") else text).encode("utf-8"))
                    store.move(f"{final}.{k}.part", final)
                    paths.append(final), errors.append(None)
                except OSError as e:
                    paths.append(None), errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(errors, pa.string())], names=["key", "output_path", "error"])

    return rows.mapInArrow(run, "key string, output_path string, error string").withColumnRenamed("key", key)


def write_manifest(summary: DataFrame, tasks: DataFrame, out_dir: str) -> str:
    """The manifest file: the one-row summary and all task entries, streamed a partition at a time."""
    store, root = _open(out_dir)
    store.create_dir(root, recursive=True)
    head = json.loads(summary.select(json_text(F.struct("*"))).first()[0])
    path = f"{root}/{MANIFEST}"
    with store.open_output_stream(path) as f:
        f.write(f'{{\n  "batch_summary": {json.dumps(head, ensure_ascii=False)},\n  "tasks": ['.encode())
        first = True
        for row in tasks.select(json_text(F.struct("*")).alias("j")).toLocalIterator(prefetchPartitions=True):
            f.write((("\n    " if first else ",\n    ") + row.j).encode("utf-8"))
            first = False
        f.write(b"\n  ]\n}\n")
    return path
