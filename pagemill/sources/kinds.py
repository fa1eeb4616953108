"""What a source is, which files are read, and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import suffix

# The suffixes that are read, in any case.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".tif")
PDF_SUFFIX, PDF_MAGIC = ".pdf", b"%PDF"
SUPPORTED = (*IMAGE_SUFFIXES, PDF_SUFFIX)


def supported(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*SUPPORTED)


def source_kind(source: Column) -> Column:
    """url or path of a textual source."""
    return F.when(F.regexp_like(F.trim(source), F.lit("^https?://")), "url").otherwise("path")


def is_pdf(kind: Column, source: Column, content: Column) -> Column:
    """A path is a PDF by its suffix alone, bytes by their first four, a URL by either."""
    named, magic = F.lower(source).endswith(PDF_SUFFIX), F.coalesce(F.substring(content, 1, 4) == F.lit(PDF_MAGIC), F.lit(False))
    return F.when(kind == "url", named | magic).when(kind == "bytes", magic).otherwise(named)


#: Ranges that a global order is cut into, and sampled rows for each.
RANGES, SAMPLED = 64, 16


def order_range(df: DataFrame, *order: str) -> Column:
    """The number of the range of ``order``, of RANGES about equally full ones, that a row falls into.

    The bounds come from the SAMPLED x RANGES rows of the smallest hashes: a uniform sample that is the same each time,
    however the rows are spread over folders, days or keys. Rows equal in ``order`` share a range.
    """
    sample = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(SAMPLED * RANGES).orderBy(*order).collect()
    bounds = list(dict.fromkeys(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in sample[SAMPLED::SAMPLED]))
    if not bounds:
        return F.lit(0)
    kinds = dict(df.select(*order).dtypes)
    value = lambda v, c: (F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)).cast(kinds[c])
    edges = F.array(*[F.struct(*[value(v, c).alias(c) for v, c in zip(b, order, strict=True)]) for b in bounds])
    return F.size(F.filter(edges, lambda b: b <= F.struct(*order)))


def numbered(paths: DataFrame, path: str = "path") -> DataFrame:
    """``path`` with its ordinal in component order, numbered without one task seeing all.

    Rows are numbered inside ranges of that order, and a range starts after the rows of the earlier ones, a window
    over one small row a range.
    """
    parted = paths.select(path, F.split(path, "/").alias("parts"))
    ranged = parted.withColumn("range", order_range(parted, "parts"))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy("parts")
    return ranged.withColumn("at", F.row_number().over(inside)).join(start, "range").select(path, (F.col("start") + F.col("at")).alias("ordinal"))
