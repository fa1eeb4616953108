"""The batch job in one call: discover, read, recognise with retries, export, manifest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from pagemill import backends
from pagemill.job import BatchJob, lines
from pagemill.operators import recognise
from pagemill.schema import JobOptions

Pager = Callable[[DataFrame], DataFrame]


def text_pages(df: DataFrame) -> DataFrame:
    """A pager for text-like content: lines are pages. Real documents need one that renders them, see ``rendered_pages``."""
    return lines(df)


def rendered_pages(dpi: int) -> Pager:
    """A pager for images and PDFs: an image is its own page, a PDF is rendered at ``dpi``; pages are encoded images."""

    def render(batches):
        import io

        import pyarrow as pa

        for batch in batches:
            at, error_at = batch.schema.get_field_index("content"), batch.schema.get_field_index("error")
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                content, error, found = row.column(at)[0].as_py(), row.column(error_at)[0].as_py(), None
                if content is not None:
                    try:
                        found = [content]
                        if content[:4] == b"%PDF":
                            found = []
                            for image in backends.render_pdf(content, dpi):
                                image.save(raw := io.BytesIO(), "PNG")
                                found.append(raw.getvalue())
                    except Exception as e:  # a broken document is a value
                        found, error = None, str(e)
                cols = [pa.array([error], pa.string()) if c == error_at else row.column(c) for c in range(batch.num_columns) if c != at]
                names = [n for c, n in enumerate(batch.schema.names) if c != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([found], pa.list_(pa.binary()))], names=[*names, "pages"])

    def pager(df: DataFrame) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "content")
        return df.mapInArrow(render, f"{kinds}, pages array<binary>")

    return pager


def run(spark: SparkSession, sources: str | list[str], options: JobOptions | None = None, pager: Pager = text_pages, factory: Callable[[], recognise.Recogniser] = recognise.EchoRecogniser, recursive: bool | None = None, **more) -> DataFrame:
    """The task table of a finished job; results and the manifest are in ``options.output_dir``.

    ``pager`` adds a ``pages`` array to rows with ``path`` and ``content``. Recognition runs once: its result is
    written beside the outputs and read again by the exports and the manifest. With nothing to do no manifest is
    written. An export that fails doesn't run recognition again: it is the task's error. ``more`` goes to BatchJob.
    """
    options = options or JobOptions(enable_dashboard=False)
    if recursive is not None:
        options = replace(options, recursive=recursive)
    return BatchJob(spark, sources, options, pager, factory, **more).run()
