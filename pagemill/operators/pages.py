"""Documents to pages: exploding, selection, limits and ordered re-assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_pages(df: DataFrame, doc: str, pages: Column, max_pages: int | None = None) -> DataFrame:
    """(doc, page, total_pages, text), one row a page, numbered from 1.

    The page limit cuts the array before it is exploded, so pages beyond it are never made; ``total_pages``
    stays the whole document's.
    """
    wanted = pages if max_pages is None else F.slice(pages, 1, max_pages) if max_pages > 0 else F.slice(pages, 1, 0)
    rows = df.select(F.col(doc), F.size(pages).alias("total_pages"), F.posexplode(wanted).alias("at", "text"))
    return rows.select(doc, (F.col("at") + 1).alias("page"), "total_pages", "text")


def select_page(total: Column, selection: Column) -> Column:
    """The page number that an integer selection means, null where it is out of range.

    Positive counts from 1, zero is the first page, negative counts from the end.
    """
    at = F.when((selection > 0) & (selection <= total), selection).when(selection < 0, total + selection + 1).when(selection == 0, F.lit(1))
    return F.when((at >= 1) & (at <= total), at)


def select_pages(total: Column, selection: Column) -> Column:
    """The page numbers of a list selection, in its order and with repeats.

    Positive counts from 1, zero is the first page; negative and out-of-range entries are dropped; if nothing is
    left, or nothing was asked for, all pages are meant.
    """
    numbered = F.transform(selection, lambda p: F.when(p > 0, p).when(p == 0, F.lit(1)))
    valid = F.filter(numbered, lambda p: p.isNotNull() & (p <= total))
    return F.when(F.size(valid) > 0, valid).otherwise(F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>")))


def assembled(texts: Column) -> Column:
    """The text of a document from its pages' texts in order: a single page bare, several each under a numbered rule."""
    headed = F.transform(texts, lambda t, k: F.concat(F.lit("--- Page "), (k + 1).cast("string"), F.lit(" ---\n"), t))
    return F.when(F.size(texts) == 1, F.get(texts, F.lit(0))).otherwise(F.array_join(headed, "\n\n"))


def assemble_pages(df: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """(doc, page_count, text) from page rows: one grouped shuffle, pages ordered inside the group by ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    grouped = df.groupBy(doc).agg(rows.alias("rows"))
    return grouped.select(doc, F.size("rows").alias("page_count"), assembled(F.col("rows.text")).alias("text"))
