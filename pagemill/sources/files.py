"""File discovery and reading.

Tasks list and read through pyarrow's file systems; stores that it doesn't know are listed through Hadoop's, on the
driver. Unlike with Spark's own file sources, names that begin with ``_`` or ``.`` are found and a missing path is
only a warning.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagemill.sources.content import URL, fetch
from pagemill.sources.kinds import SUPPORTED, supported

logger = logging.getLogger(__name__)
LISTED = "path string, length long"


def listing(spark: SparkSession, source: str, recursive: bool = True) -> Iterator[tuple[str, int]]:
    """(path, length) of the files at or below ``source``, lazily; nothing, with a warning, if it doesn't exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        logger.warning("Skipping missing source: %s", source)
        return
    if fs.getFileStatus(path).isDirectory():
        found = fs.listFiles(path, recursive)
        while found.hasNext():
            status = found.next()
            yield _plain(status.getPath()), status.getLen()
    else:
        yield _plain(path.makeQualified(fs.getUri(), fs.getWorkingDirectory())), fs.getFileStatus(path).getLen()


def _plain(path) -> str:
    uri = path.toUri()
    return uri.getPath() if (uri.getScheme() or "file") == "file" else path.toString()


def _store(path: str):
    """The pyarrow file system of a path, the path inside it, and what precedes that in the path."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, "" if path.startswith("file:") else path[: path.index(inner)] if inner in path else f"{path.split('://')[0]}://"


def _below(batches: Iterator[pa.RecordBatch], recursive: bool) -> Iterator[pa.RecordBatch]:
    """(path, length, folder) of what is in each folder, or at any depth below it; a file stands for itself."""
    from pyarrow import fs

    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, inner, head = _store(path)
            info = store.get_file_info(inner)
            if info.type == fs.FileType.Directory:
                found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=recursive))
            else:
                found = [info]
            for k in range(0, len(found), 10_000):
                own = [x for x in found[k : k + 10_000] if x.type in (fs.FileType.File, fs.FileType.Directory)]
                names = [f"{head}{x.path}" for x in own]
                yield pa.record_batch([pa.array(names, pa.string()), pa.array([x.size or 0 for x in own], pa.int64()), pa.array([x.type == fs.FileType.Directory for x in own], pa.bool_())], names=["path", "length", "folder"])


def _readable(source: str) -> bool:
    """Whether pyarrow, which tasks list with, opens the source's store."""
    try:
        _store(source)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def discover(spark: SparkSession, sources: str | list[str], recursive: bool = True) -> DataFrame:
    """(path, length) of the supported files of one source or several, each once, in component order.

    Tasks do the listing: one for each source's own folder, then one for each folder in it, whose whole tree it
    lists. Sources of stores that tasks can't open are listed by the driver. A source that doesn't exist is a warning.
    """
    names = [sources] if isinstance(sources, str) else list(sources)
    near = [s for s in names if _readable(s)]
    rows = [r for s in names if s not in near for r in listing(spark, s, recursive)]
    found = spark.createDataFrame(rows, LISTED)
    near = [_plain(p) for s in near if (p := _existing(spark, s)) is not None]
    if near:
        kind = f"{LISTED}, folder boolean"
        top = spark.createDataFrame([(s,) for s in near], "path string").repartition(len(near), "path").mapInArrow(lambda it: _below(it, False), kind)
        found = found.unionByName(top.where("NOT folder").drop("folder"))
        if recursive:
            # folders are dealt out by name, so that large ones meet by chance alone
            deep = top.where("folder").select("path").repartition("path").mapInArrow(lambda it: _below(it, True), kind)
            found = found.unionByName(deep.where("NOT folder").drop("folder"))
    return found.where(supported(F.col("path"))).dropDuplicates(["path"]).orderBy(F.split("path", "/"))


def _existing(spark: SparkSession, source: str):
    """The qualified path of a source, or None with a warning."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        logger.warning("Skipping missing source: %s", source)
        return None
    return path.makeQualified(store.getUri(), store.getWorkingDirectory())


def read_content(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with content and error columns; files are read, and URLs fetched, by the tasks, one at a time. Paths need a store that pyarrow opens."""
    at, names = df.columns.index(path), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, content, error = batch.slice(k, 1), None, None
                try:
                    name = batch.column(at)[k].as_py()
                    if URL.match(name):
                        content = fetch(name)
                    else:
                        store, inner, _ = _store(name)
                        with store.open_input_stream(inner) as f:
                            content = f.read()
                except OSError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*names, "content", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, content binary, error string")


class DocumentSource(DataSource):
    """``spark.read.format("documents").load(folder)``: path, length and content of supported files of a folder that the
    driver and executors share. Options: recursive (true), filesPerPartition (64)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.recursive = options["path"], options.get("recursive", "true").lower() == "true"
        self.each = int(options.get("filesPerPartition", "64"))

    def partitions(self) -> list[InputPartition]:
        import os

        found = []
        for folder, folders, names in os.walk(self.root):
            found += [os.path.join(folder, n) for n in names if os.path.splitext(n)[1].lower() in SUPPORTED]
            if not self.recursive:
                folders.clear()
        found.sort(key=lambda p: p.split("/"))
        return [_Files(found[k : k + self.each]) for k in range(0, len(found), self.each)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                content = f.read()
            yield path, len(content), content
