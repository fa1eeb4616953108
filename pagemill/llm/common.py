"""Helpers that the training-data operators share: batching, hashing, shared folders."""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles at once; a longer single text is one step of its own.
STEP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns ``cols`` of a table, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def small_batches(spark: SparkSession, rows: int = 400, size: str = "4m") -> None:
    """Bound the session's Arrow batches, which hold whole texts: ``rows`` rows and about ``size`` bytes, or one longer text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: What to call when another operator's tasks come to a worker: Spark keeps workers, and their caches, between jobs.
CLEAR: dict[str, list[Callable[[], None]]] = {}
_LIBC = ctypes.CDLL(None)
_owner = ""


def task(owner: str) -> Callable:
    """For generators over Arrow batches: before the first batch the caches of other operators are emptied, and after the
    last freed memory goes back to the system, so that an idle worker holds little more than its own operator's cache."""

    def wrap(run: Callable) -> Callable:
        @functools.wraps(run)
        def tidy(*args, **kwargs) -> Iterator[pa.RecordBatch]:
            global _owner
            if _owner not in ("", owner):
                for name, clear in CLEAR.items():
                    if name != owner:
                        for c in clear:
                            c()
            _owner = owner
            try:
                yield from run(*args, **kwargs)
            finally:
                pa.default_memory_pool().release_unused()
                if hasattr(_LIBC, "malloc_trim"):
                    _LIBC.malloc_trim(0)

        return tidy

    return wrap


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset a local master, whose executors are the driver's own process, gets a folder of its own; on a
    cluster there is no folder that could be guessed, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    _MADE.append(path := f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}")
    return path


_MADE: list[str] = []


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables that this session's operators wrote to the shared folder; results read from them end with it.

    To be called once results are written. Returns how many there were.
    """
    n, jvm = len(_MADE), spark.sparkContext._jvm
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


#: Spark's own switch: the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: its lineage ends there, and so do its shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    spark, path = df.sparkSession, df._llm_path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of a plan (file sizes for a scan); never reads data. 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else 0


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns an operator reads, under fixed names; other columns can't clash."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def tags(text: Column) -> list[Column]:
    """128 bits of a text: with the id they name a row, whatever ids it shares."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls and its offsets, without a Python object a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their texts' UTF-8 bytes and offsets (len rows + 1); a null text is empty.

    A slice ends when its texts pass ``limit`` bytes, so memory follows the longest text, not the batch.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.fill_null("")
        col = col.cast(pa.large_binary())
    else:
        col = col.fill_null(b"").cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    buffer = col.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        end = min(end, n)
        yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), so that nearby sums give unrelated values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions start, start + 1, ... of each of several ranges, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, e = starts[keep], ends[keep]
    out[0] = s[0]
    out[e[:-1]] = s[1:] - (s[:-1] + lengths[keep][:-1] - 1)
    return np.cumsum(out)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in the first ``keys`` columns (integers without nulls).

    With rows partitioned and sorted by those columns this is a group-by without a Python call per group's batch.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of undirected edges and of each the smallest node it is joined with: hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


#: Edges (16 bytes each) that one task may solve.
ONE_TASK = 2_000_000


@task("components")
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as stars around the smallest node of each of its own components."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, least = least_labels(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        for k in range(0, len(nodes), 100_000):
            yield pa.record_batch([pa.array(nodes[k : k + 100_000]), pa.array(least[k : k + 100_000])], names=["u", "v"])


def components(edges: DataFrame, name: str = "components", rounds: int = 40, bound: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node of undirected edges (u, v); component is its smallest reachable node.

    Each task first contracts its own edges to stars, which leaves at most an edge a node and task. As many as
    ``bound`` of them, by their count, are solved in one task. Else alternating large-star and small-star steps
    follow, each a grouped minimum (combined before the shuffle) and a join that AQE can split where a hub has most
    edges; each round is written to the shared folder. Self-loops keep a lone node in the result.
    """
    distinct = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()
    local = materialise(distinct.mapInArrow(_contract, "u long, v long"), f"{name}-0")
    if local.count() <= bound:
        return materialise(local.repartition(1).mapInArrow(_contract, "node long, component long"), f"{name}-1")
    pairs = local.distinct()
    loops = pairs.where("u == v")
    state = None
    for k in range(rounds):
        both = pairs.where("u != v")
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node whose neighbours are all smaller keeps its link to the least of them
        large = large.unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = materialise(small, f"{name}-{k + 1}")
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state:
            break
        state = (now.n, now.h)
    else:
        raise RuntimeError("connected components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return found.unionByName(loops.select(F.col("u").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
