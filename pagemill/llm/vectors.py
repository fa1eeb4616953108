"""Near-duplicate vectors by sorted projection passes.

A pass gives every vector a key of concatenated random-hyperplane bits, sorts by it, and compares each vector
with a bounded window of followers in that order; verified pairs of all passes are united. The number of
passes follows from the number of vectors, so that the chance to miss a pair at the threshold stays the same at
any size. Vectors that crowd under few keys outgrow the window: runs of one key prefix that hold more rows, in
different components, are compared in full in bounded tiles, at the prefix length that their measured sizes make
cheapest. Links are then counted exactly by comparing the members of each component in bounded tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import components, materialise, runs, task

BITS, NEIGHBOURS, MISS, PASSES_AT_ONCE, TILE, ROWS = 62, 64, 1e-3, 4, 1024, 100_000
#: Passes that key density is measured on, bits between the prefix lengths tried, comparisons that a row of a tile costs.
MEASURED, BETWEEN, SHIP = 2, 3, 500


def passes_for(n: int, threshold: float, window: int = NEIGHBOURS, miss: float = MISS) -> int:
    """Passes after which two vectors at the threshold have failed to meet in any window with chance ``miss``."""
    return max(6, passes_of(max(1.0, math.log2(max(n, 2) / window) + 1), threshold, miss))


def passes_of(bits: float, threshold: float, miss: float = MISS) -> int:
    """Passes after which two vectors at the threshold have shared no key prefix of ``bits`` with chance ``miss``."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - agree)) if agree < 1 else 1


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column whose rows have one length, as unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # scaled first, so that tiny or huge components keep their direction
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for d in np.unique(sizes):
        yield int(d), batch.filter(pa.array(sizes == d))


@task("vectors")
def _keys(batches: Iterator[pa.RecordBatch], passes: list[int]) -> Iterator[pa.RecordBatch]:
    planes: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for d, part in _by_dimension(batch, 1):
            x = _rows(part.column(1))
            for p in passes:
                if (p, d) not in planes:
                    planes[p, d] = np.random.default_rng((p, d)).normal(size=(d, BITS))
                bits = (x @ planes[p, d] >= 0).astype(np.int64)
                code = bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                n = part.num_rows
                yield pa.record_batch([pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, d, np.int32)), pa.array(code), part.column(0), part.column(1)], names=["pass", "dim", "code", "id", "vector"])


@task("vectors")
def _across(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each tile (pass, dim, prefix, a, b): the pairs of components with a row each that are linked."""
    for group in runs(batches, 5):
        a, b = group.column(3)[0].as_py(), group.column(4)[0].as_py()
        order = np.argsort(group.column(6).to_numpy(), kind="stable")
        side, comp = group.column(5).to_numpy()[order], group.column(6).to_numpy()[order]
        x = _rows(group.column(7).take(pa.array(order)))
        left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
        found: set[tuple[int, int]] = set()
        for i in range(0, len(left), 512):
            rows, others = left[i : i + 512], right
            if comp[rows[0]] == comp[rows[-1]]:  # nothing new inside one component
                others = right[comp[right] != comp[rows[0]]]
            near = (x[rows] @ x[others].T) >= threshold
            near &= comp[rows][:, None] != comp[others][None, :]
            u, v = np.nonzero(near)
            found.update(map(tuple, np.unique(np.stack([comp[rows[u]], comp[others[v]]], axis=1), axis=0).tolist()))
        yield pa.record_batch([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])


def crowded(classes: DataFrame, grouped: DataFrame, n: int, threshold: float, window: int) -> DataFrame:
    """Links (u, v) between components, among vectors that share a key prefix with more rows than the window.

    Two vectors at the threshold share a prefix of b bits in one of passes_of(b) passes but for chance MISS, however
    many others share it; b = 0 compares all. Of the lengths up to the windows' own the one of the fewest
    comparisons is taken, by sizes measured on all rows. Small tables don't lean on the windows at all.
    """
    spark = classes.sparkSession
    kind = dict(classes.dtypes)["vector"][6:-1]
    schema = f"pass int, dim int, code long, id long, vector array<{kind}>"
    placed = grouped.withColumnRenamed("node", "id")
    least = window + 1 if n > ROWS else 1

    def coded(passes: list[int]) -> DataFrame:
        return classes.select("rep", "vector").mapInArrow(lambda it: _keys(it, passes), schema).select("pass", "dim", "code", "id").join(placed, "id", "left").withColumn("component", F.coalesce("component", "id"))

    top = min(BITS, max(0, math.floor(math.log2(max(n, 2) / window) + 1)))
    lengths = sorted({0, *range(top, 0, -BETWEEN)})
    prefixes = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.expr(f"shiftright(code, {BITS - b})").alias("prefix")) for b in lengths])).alias("p")
    counted = coded(list(range(MEASURED))).select("pass", "dim", "component", prefixes).groupBy("pass", "dim", "p", "component").agg(F.count("*").cast("double").alias("c"))
    counted = counted.groupBy("pass", "dim", "p").agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("same")).where(f"rows > {least} AND rows * rows > same")
    # all lengths are measured on the same passes, so their sums compare
    costs = {r.b: r.cost for r in counted.groupBy("p.b").agg(F.sum((F.col("rows") * F.col("rows") - F.col("same")) / 2 + SHIP * F.col("rows") * F.ceil(F.col("rows") / TILE)).alias("cost")).collect()}
    bits = min(lengths, key=lambda b: (costs.get(b, 0) * passes_of(b, threshold), b))
    links = spark.createDataFrame([], "u long, v long")
    wanted = passes_of(bits, threshold)
    for start in range(0, wanted, PASSES_AT_ONCE):
        codes = coded(list(range(start, min(wanted, start + PASSES_AT_ONCE)))).selectExpr("pass", "dim", f"shiftright(code, {BITS - bits}) AS prefix", "id", "component")
        codes = materialise(codes, "vector-codes")
        full = codes.groupBy("pass", "dim", "prefix").agg(F.count("*").alias("rows"), F.min("component").alias("c0"), F.max("component").alias("c1")).where(f"rows > {least} AND c0 != c1")
        full = full.select("pass", "dim", "prefix", F.ceil(F.col("rows") / TILE).cast("int").alias("chunks"))
        rows = codes.join(full, ["pass", "dim", "prefix"]).join(classes.select(F.col("rep").alias("id"), "vector"), "id")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        tiles = rows.select("pass", "dim", "prefix", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "component", "vector")
        tiles = tiles.repartition("pass", "dim", "prefix", "a", "b").sortWithinPartitions("pass", "dim", "prefix", "a", "b")
        links = links.unionByName(tiles.mapInArrow(lambda it: _across(it, threshold), "u long, v long"))
    return links


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _window_edges(ids: np.ndarray, x: np.ndarray, threshold: float, window: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the verified pairs at most ``window`` places apart."""
    forest, us, vs = Forest(len(ids)), [], []
    for gap in range(1, min(window, len(ids) - 1) + 1):
        near = np.einsum("ij,ij->i", x[:-gap], x[gap:]) >= threshold
        for i in np.flatnonzero(near).tolist():
            if forest.join(i, i + gap):
                us.append(int(ids[i]))
                vs.append(int(ids[i + gap]))
    return us, vs


@task("vectors")
def _edges(batches: Iterator[pa.RecordBatch], threshold: float, window: int) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, 2):
        for start in range(0, group.num_rows, ROWS):
            # consecutive steps overlap by the window, so no neighbours are parted
            part = group.slice(max(0, start - window), min(ROWS, group.num_rows - start) + min(window, start))
            us, vs = _window_edges(part.column(3).to_numpy(), _rows(part.column(4)), threshold, window)
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


@task("vectors")
def _counts(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each tile (component, a, b): for each row of chunk a the copies linked in chunk b, and the other way round."""
    for group in runs(batches, 3):
        a, b = group.column(1)[0].as_py(), group.column(2)[0].as_py()
        side, ids, copies = (group.column(k).to_numpy() for k in (3, 4, 5))
        dims = pa.compute.list_value_length(group.column(6)).to_numpy()
        total = np.zeros(len(ids), np.int64)
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            x = _rows(group.column(6).take(pa.array(own)))
            left, right = np.flatnonzero(side[own] == a), np.flatnonzero(side[own] == b)
            for i in range(0, len(left), 512):
                rows = left[i : i + 512]
                near = (x[rows] @ x[right].T) >= threshold
                near[own[rows][:, None] == own[right][None, :]] = False
                total[own[rows]] += near @ copies[own[right]]
                if a != b:
                    total[own[right]] += copies[own[rows]] @ near
        yield pa.record_batch([pa.array(ids), pa.array(total)], names=["id", "linked"])


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, window: int = NEIGHBOURS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors
    of different lengths. Equal vectors become one with a multiplicity, so copies cost nothing and are linked
    without a comparison. An id that repeats counts row by row; a null id stays, unlinked, with a null component;
    an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    ok = usable(F.col("vector")) & F.col("id").isNotNull()
    keyed = rows.select("id", F.when(ok, F.xxhash64("vector")).alias("h1"), F.when(ok, F.xxhash64(F.lit(1), "vector")).alias("h2"), F.when(ok, F.col("vector")).alias("vector"))
    classes = keyed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    classes = materialise(classes, "classes")
    n = classes.count()
    wanted = passes_for(n, threshold, window)
    found = None
    for start in range(0, wanted, PASSES_AT_ONCE):
        own = list(range(start, min(wanted, start + PASSES_AT_ONCE)))
        coded = classes.select("rep", "vector").mapInArrow(lambda it, own=own: _keys(it, own), "pass int, dim int, code long, id long, vector array<" + dict(classes.dtypes)["vector"][6:-1] + ">")
        parts = max(1, -(-n * len(own) // ROWS))
        ordered = coded.repartitionByRange(parts, "pass", "dim", "code").sortWithinPartitions("pass", "dim", "code")
        edges = ordered.mapInArrow(lambda it: _edges(it, threshold, window), "u long, v long")
        found = edges if found is None else found.unionByName(edges)
    grouped = materialise(components(found, "vectors"), "vector-components")
    more = materialise(crowded(classes, grouped, n, threshold, window).distinct(), "vector-links")
    if not more.isEmpty():
        every = grouped.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
        grouped = materialise(components(every, "vectors-crowded"), "vector-components")
    sizes = grouped.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    members = grouped.join(sizes, "component").join(classes.withColumnRenamed("rep", "node"), "node")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    tiled = members.withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.select("component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", F.col("node").alias("id"), "copies", "vector")
    tiled = tiled.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b")
    linked = tiled.mapInArrow(lambda it: _counts(it, threshold), "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))
    known = classes.select("h1", "h2", "rep", "copies").join(grouped.withColumnRenamed("node", "rep"), "rep", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
