"""Recognisers as vectorised operators: one model per Python worker, Arrow batches in and out."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagemill.schema import FAILED, COMPLETED


class Recogniser(ABC):
    """What reads a page. ``load`` is idempotent and runs in the worker, once, before the first page."""

    def load(self) -> None:
        """Put weights into memory."""

    @abstractmethod
    def predict(self, page, prompt: str | None = None, max_new_tokens: int = 512) -> str:
        """The text of one page; raises if it can't be read."""

    def device_requirements(self) -> dict[str, object]:
        return {"cuda": False, "min_vram_gb": 0.0}


class EchoRecogniser(Recogniser):
    """A deterministic stand-in: pages are texts already, and come back marked and stripped."""

    def predict(self, page, prompt: str | None = None, max_new_tokens: int = 512) -> str:
        if isinstance(page, (bytes, bytearray)):
            page = page.decode("utf-8", "replace")
        return f"ocr:{page.strip()}"


_LOADED: dict[str, Recogniser] = {}


def _loaded(key: str, factory: Callable[[], Recogniser]) -> Recogniser:
    """The worker's own instance: a reused worker doesn't load twice."""
    if key not in _LOADED:
        model = factory()
        model.load()
        _LOADED[key] = model
    return _LOADED[key]


def with_retries(call: Callable[[], str], max_retries: int) -> tuple[str, str | None, int, str | None]:
    """(status, text, retries, error) of a call that is repeated at once when it raises.

    A success after retries keeps the last retry's message; a failure keeps the plain error.
    """
    error: str | None = None
    for attempt in range(max_retries + 1):
        try:
            return COMPLETED, call(), attempt, error
        except Exception as e:  # a document's failure is a value, whatever it was
            raw = str(e) or "Unknown error"
            if attempt == max_retries:
                return FAILED, None, attempt, raw
            error = f"Retrying attempt {attempt + 1}/{max_retries}: {raw}"
    raise AssertionError("unreachable")


def _call(model: Recogniser, page, prompt: str | None, max_new_tokens: int | None) -> str:
    return model.predict(page, prompt) if max_new_tokens is None else model.predict(page, prompt, max_new_tokens=max_new_tokens)


def recognise_pages(df: DataFrame, page: str, out: str = "recognised", factory: Callable[[], Recogniser] = EchoRecogniser, prompt: str | None = None, key: str | None = None, error: str | None = None, max_new_tokens: int | None = None) -> DataFrame:
    """``df`` with the recognised text of its ``page`` column. Narrow; long documents spread over tasks by their pages.

    A null page stays null. A page that can't be read has no text either; ``error`` names a column for the reason.
    """
    at, name = df.columns.index(page), key or factory.__name__
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), *([T.StructField(error, T.StringType())] if error else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(name, factory)
        for batch in batches:
            texts: list[str | None] = []
            errors: list[str | None] = []
            for v in batch.column(at).to_pylist():
                text = reason = None
                if v is not None:
                    try:
                        text = _call(model, v, prompt, max_new_tokens)
                    except Exception as e:  # one page's failure is a value
                        reason = str(e) or "Unknown error"
                texts.append(text)
                errors.append(reason)
            more = [pa.array(errors, pa.string())] if error else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), *more], names=schema.names)

    return df.mapInArrow(run, schema)


def recognise_documents(df: DataFrame, pages: str, factory: Callable[[], Recogniser] = EchoRecogniser, max_retries: int = 2, prompt: str | None = None, key: str | None = None, max_new_tokens: int | None = None) -> DataFrame:
    """``df`` without its ``pages`` array, with texts (array), status, retries, error and the worker's clock at its start and
    end: a document in one task, no shuffle.

    A document is retried as a whole, at once, up to ``max_retries`` times; no pages give no texts. The duration is
    that of the last attempt.
    """
    at, name = df.columns.index(pages), key or factory.__name__
    rest = [f for f in df.schema.fields if f.name != pages]
    extra = T.StructType.fromDDL("texts array<string>, status string, retries int, error string, started_at double, completed_at double, duration_sec double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(name, factory)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for own in batch.column(at).to_pylist():
                result: list[str] = []

                attempts: list[float] = []

                def read(own=own, result=result, attempts=attempts) -> str:
                    attempts.append(time.perf_counter())
                    result[:] = [_call(model, p, prompt, max_new_tokens) for p in own or ()]
                    return ""

                began = time.time()
                status, _, retries, error = with_retries(read, max_retries)
                took = time.perf_counter() - attempts[-1]
                for col, v in zip(rows, (result if status == COMPLETED else None, status, retries, error, began, time.time(), took), strict=True):
                    col.append(v)
            kinds = (pa.list_(pa.string()), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names=[*(f.name for f in rest), *extra.names])

    return df.mapInArrow(run, T.StructType([*rest, *extra.fields]))
