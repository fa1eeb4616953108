"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmaps, sorted-array intersection.

Equal sets become one. Candidates come from the prefix filter: in any common order of all shingles, two sets
with Jaccard similarity t share one of their first n - ceil(t n) + 1. The order puts shingles first that are
not frequent, so groups are small. Bitmaps of parities bound the overlap from above: with the smallest member of a
group's size band first, then, for what that leaves apart, pair by pair in tiles of one group, one pair of chunks
and neighbouring size bands. A tile gives a spanning forest of the pairs its bitmaps allow, never the pairs, so
all that may be linked ends up in one cluster with fewer edges than members. Inside a cluster, again in tiles,
sorted arrays are intersected exactly wherever bitmaps allow it and nothing has joined the two sets yet, and a
spanning forest of the links remains. No pair above the threshold is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.anchors import BASE1, BASE2, NO_ID, Sums, _BYTES, word_bounds
from pagemill.llm.common import components, discard, input_bytes, materialise, mix, pieces, runs, tags, task

SHINGLE, THRESHOLD = 3, Fraction(9, 10)
#: Counters of the frequency sketch, bits of a set's bitmap, members of a chunk of a group, bytes of a step.
COUNTERS, BITS, TILE, STEP = 1 << 20, 1024, 1024, 400_000
#: Sets and shingles of a chunk of a cluster.
MEMBERS, SHINGLES = 4_096, 1_000_000
#: A counter is frequent from this share of a task's documents on; more than 2^20 shingles can't reach it by chance.
FREQUENT = 0.002

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- sets


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE, measure: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all shingles of several texts, repeats included, each text's bounds in them, and (``measure``) a length class:
    0 for shingles of the most letters, 15 for those of the fewest."""
    start, end, bounds = word_bounds(data, offsets)
    words = Sums(_BYTES[_LOWER[data]], BASE2).of(start, end) ^ mix((end - start).astype(np.uint64))
    count = np.diff(bounds)
    per = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=out[1:])
    owner = np.repeat(np.arange(len(per)), per)
    first = np.arange(int(out[-1])) - out[owner] + bounds[owner]
    last = np.minimum(first + width, bounds[owner + 1])
    hashes = Sums(words, BASE1).of(first, last) ^ (last - first).astype(np.uint64)
    if not measure:
        return hashes, out
    letters = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=letters[1:])
    return hashes, out, (15 - np.minimum((letters[last] - letters[first]) // width, 15)).astype(np.uint64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles at each place: as many bits differ between two sets as shingles at most.

    A large set has more places, at least half as many as shingles, or the bound would mean nothing; halves of a
    longer bitmap combine by exclusive or into the shorter one, see ``fold``.
    """
    places = max(BITS, 1 << (len(shingles) // 2).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8), bitorder="little")


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to ``words`` words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def differing(x: bytes | np.ndarray, y: bytes | np.ndarray) -> int:
    """Differing bits of two bitmaps at the length of the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    words = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum())


def prefix_size(n: int, threshold: Fraction = THRESHOLD) -> int:
    return n - -(-n * threshold.numerator // threshold.denominator) + 1


@task("jaccard")
def _count(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The task's frequent counters; a document counts once a shingle."""
    counts, docs = np.zeros(COUNTERS, np.int64), 0
    for batch in batches:
        for part, data, offsets in pieces(batch, limit=STEP):
            h, _ = shingle_hashes(data, offsets, width)
            counts += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
            docs += part.num_rows
    heavy = np.flatnonzero(counts >= max(8, FREQUENT * docs))
    yield pa.record_batch([pa.array(heavy.astype(np.int32)), pa.array(counts[heavy])], names=["counter", "n"])


def frequency_levels(docs: DataFrame, width: int) -> np.ndarray:
    """A level for each counter: 0 for what isn't frequent, one more with each doubling. Fixed size, whatever the corpus."""
    total = max(1, docs.count())
    counted = docs.mapInArrow(lambda it: _count(it, width), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    heavy = counted.where(F.col("n") >= FREQUENT * total / 2).select("counter", F.least(F.lit(10), F.floor(F.log2(F.col("n") / (FREQUENT * total / 2)))).cast("int").alias("level"))
    levels = np.zeros(COUNTERS, np.uint8)
    for r in heavy.collect():  # at most COUNTERS rows
        levels[r.counter] = r.level + 1
    return levels


SETS = "id long, tag struct<t1: long, t2: long>, n int, h1 long, h2 long, prefix binary, bits binary"


@task("jaccard")
def _sets(batches: Iterator[pa.RecordBatch], width: int, threshold: Fraction, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    high = levels.astype(np.uint64) << np.uint64(60)
    for batch in batches:
        for part, data, offsets in pieces(batch, limit=STEP):
            h, bounds, short = shingle_hashes(data, offsets, width, measure=True)
            n, h1, h2, prefix, bits = [], [], [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                s, at = np.unique(h[a:b], return_index=True)
                n.append(len(s))
                if not len(s):
                    h1.append(0), h2.append(0), prefix.append(b""), bits.append(b"")
                    continue
                h1.append(int(mix(s).sum()) - (1 << 63))
                h2.append(int(mix(s ^ np.uint64(0x5555555555555555)).sum()) - (1 << 63))
                k = prefix_size(len(s), threshold)
                # frequent ones last, then those of few letters, which chance brings together most
                key = high[(s >> np.uint64(44)).astype(np.int64)] | short[a:b][at] << np.uint64(56) | s >> np.uint64(8)
                prefix.append((np.partition(key, k - 1)[:k] if k < len(s) else key).tobytes())
                bits.append(bitmap(s).tobytes())
            yield pa.record_batch([part.column(0), part.column(2), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())], names=["id", "tag", "n", "h1", "h2", "prefix", "bits"])


# ---------------------------------------------------------------- groups of sets that share a prefix shingle


@task("jaccard")
def _tokens(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """One packed row per step and bucket for ordinary shingles; frequent ones as rows, which joins can split."""
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    tokens: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        i, n, t = np.concatenate(ids), np.concatenate(sizes), np.concatenate(tokens)
        heavy = (t >> np.uint64(60)) > 0
        where = np.flatnonzero(heavy)
        for k in range(0, len(where), 50_000):
            own = where[k : k + 50_000]
            m = len(own)
            yield pa.record_batch([pa.array(np.full(m, -1, np.int32)), pa.array([None] * m, pa.binary()), pa.array(t[own].view(np.int64)), pa.array(i[own]), pa.array(n[own].astype(np.int32))], names=["bucket", "packed", "grp", "id", "n"])
        i, n, t = i[~heavy], n[~heavy], t[~heavy]
        b = (mix(t) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        i, n, t, b = i[order], n[order], t[order], b[order]
        cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
        rows = [(int(b[x]), t[x:y].tobytes() + np.ascontiguousarray(i[x:y].view(np.uint8).reshape(-1, 8).T).tobytes() + np.ascontiguousarray(n[x:y].astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
        nulls = pa.nulls(len(rows), pa.int64())
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), nulls, nulls, pa.nulls(len(rows), pa.int32())], names=["bucket", "packed", "grp", "id", "n"])

    for batch in batches:
        prefix = [np.frombuffer(p.as_py(), np.uint64) for p in batch.column(2)]
        per = [len(p) for p in prefix]
        ids.append(np.repeat(batch.column(0).to_numpy(), per))
        sizes.append(np.repeat(batch.column(1).to_numpy(), per))
        tokens.append(np.concatenate(prefix) if prefix else np.zeros(0, np.uint64))
        held += sum(per)
        if held >= 500_000:
            yield from flush()
            ids.clear(), sizes.clear(), tokens.clear()
            held = 0
    if held:
        yield from flush()


@task("jaccard")
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, id, n): members of each shingle that several sets have; shingles with the same members make one group."""
    for group in runs(batches, 1):
        t, i, n = [], [], []
        for packed in group.column(1):
            raw = packed.as_py()
            k = len(raw) // 20
            t.append(np.frombuffer(raw, np.uint64, k))
            i.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * k, 8 * k).reshape(8, k).T).view(np.int64).reshape(k))
            n.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * k, 16 * k).reshape(4, k).T).view(np.int32).reshape(k))
        token, ids, sizes = np.concatenate(t), np.concatenate(i), np.concatenate(n)
        order = np.lexsort((ids, token))
        token, ids, sizes = token[order], ids[order], sizes[order]
        # a set that came twice counts once
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])
        token, ids, sizes = token[fresh], ids[fresh], sizes[fresh]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(first, len(token)))
        several = np.repeat(size > 1, size)
        if not several.any():
            continue
        mark = np.add.reduceat(mix(ids.view(np.uint64)), first) ^ mix(size.astype(np.uint64))
        _, own = np.unique(mark, return_index=True)
        chosen = np.zeros(len(first), bool)
        chosen[own] = True
        keep = np.flatnonzero(np.repeat(chosen, size) & several)
        grp = np.repeat(mark, size)
        for k in range(0, len(keep), 50_000):
            o = keep[k : k + 50_000]
            yield pa.record_batch([pa.array(grp[o].view(np.int64)), pa.array(ids[o]), pa.array(sizes[o])], names=["grp", "id", "n"])


# ---------------------------------------------------------------- pairs


class Labels:
    """Which rows are joined, as one label a row, so that whole blocks of rows are compared at once."""

    def __init__(self, label: np.ndarray):
        self.of = np.unique(label, return_inverse=True)[1]

    def join(self, i: int, j: int) -> bool:
        x, y = self.of[i], self.of[j]
        if x != y:
            self.of[self.of == x] = y
        return x != y


class Maps:
    """Bitmaps of rows in ascending order of size: they lengthen with the size, so each length is a range of rows."""

    def __init__(self, raw: list[bytes]):
        words = np.array([len(x) // 8 for x in raw])
        cuts = [0, *(np.flatnonzero(np.diff(words)) + 1).tolist(), len(words)]
        self.parts = [(x, y, np.frombuffer(b"".join(raw[x:y]), np.uint64).reshape(y - x, -1)) for x, y in zip(cuts, cuts[1:], strict=False)]

    def allowed(self, n: np.ndarray, threshold: Fraction) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """Blocks (first row, its end, first other row) with the differing bits of each pair and whether sizes and bits allow the threshold."""
        p, q = threshold.numerator, threshold.denominator
        for x, y, left in self.parts:
            block = int(np.clip(1_000_000 // (len(n) * left.shape[1]), 1, 64))  # of at most 8 MB a step
            for start in range(x, y, block):
                stop = min(start + block, y)
                end = int(np.searchsorted(n, n[stop - 1] * q // p, side="right"))
                for x2, y2, right in self.parts:
                    lo, hi = max(start, x2), min(end, y2)
                    if hi <= lo:
                        continue
                    near = np.bitwise_count(left[start - x : stop - x, None, :] ^ fold(right[lo - x2 : hi - x2], left.shape[1])[None]).sum(axis=2, dtype=np.int64)
                    total = n[start:stop, None] + n[None, lo:hi]
                    # overlap <= (total - differing bits) / 2, and similarity t needs overlap >= t / (1 + t) * total
                    ok = ((total - near) * (p + q) >= 2 * p * total) & (n[start:stop, None] * q >= n[None, lo:hi] * p)
                    ok &= np.arange(start, stop)[:, None] < np.arange(lo, hi)[None, :]
                    yield start, stop, lo, near, ok


def _edges(us: list[int], vs: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


@task("jaccard")
def _tiles(batches: Iterator[pa.RecordBatch], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """Of each tile (grp, band, a, b) a spanning forest of the pairs in different components whose sizes and bitmaps allow the threshold."""
    for group in runs(batches, 4):
        a, b = group.column(2)[0].as_py(), group.column(3)[0].as_py()
        own, ids, comp, n = (group.column(k).to_numpy() for k in (4, 5, 6, 7))
        order = np.argsort(n, kind="stable")
        own, ids, n, labels = own[order], ids[order], n[order].astype(np.int64), Labels(comp[order])
        raw = group.column(8).to_pylist()
        us, vs = [], []
        for start, stop, lo, _, ok in Maps([raw[k] for k in order.tolist()]).allowed(n, threshold):
            ok &= labels.of[start:stop, None] != labels.of[None, lo : lo + ok.shape[1]]
            if a != b:
                ok &= own[start:stop, None] != own[None, lo : lo + ok.shape[1]]
            i, j = np.nonzero(ok)
            i, j = i + start, j + lo
            # one pair stands for all that would join the same two labels
            first = np.unique(labels.of[i] * len(n) + labels.of[j], return_index=True)[1]
            for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
                if labels.join(x, y):
                    us.append(int(ids[x]))
                    vs.append(int(ids[y]))
        yield _edges(us, vs)


@task("jaccard")
def _possible(batches: Iterator[pa.RecordBatch], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """The rows (u, v, n, m, bits of u, bits of v) whose bitmaps allow the threshold, as (u, v)."""
    p, q = threshold.numerator, threshold.denominator
    for batch in batches:
        left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        differ = np.zeros(batch.num_rows, np.int64)
        lengths = np.array([len(x) << 32 | len(y) for x, y in zip(left, right, strict=True)], np.int64)
        for pair in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == pair)
            x, y = (np.frombuffer(b"".join(side[k] for k in own.tolist()), np.uint64).reshape(len(own), -1) for side in (left, right))
            words = min(x.shape[1], y.shape[1])
            differ[own] = np.bitwise_count(fold(x, words) ^ fold(y, words)).sum(axis=1, dtype=np.int64)
        total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        yield batch.select([0, 1]).filter(pa.array((total - differ) * (p + q) >= 2 * p * total))


def similar(s: np.ndarray, t: np.ndarray, threshold: Fraction) -> bool:
    """Whether two sorted sets have the threshold's similarity, by looking the smaller one's members up in the other."""
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    common = int(np.count_nonzero(t[at] == s))
    return threshold.denominator * common >= threshold.numerator * (len(s) + len(t) - common)


@task("jaccard")
def _exact(batches: Iterator[pa.RecordBatch], width: int, threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """Of each tile (cluster, a, b) a spanning forest of its links: bitmaps first, then sorted sets, and only between rows not yet joined."""
    for group in runs(batches, 3):
        a, b = group.column(1)[0].as_py(), group.column(2)[0].as_py()
        own, ids = (group.column(k).to_numpy() for k in (3, 4))
        sets: list[np.ndarray] = []
        for batch in group.to_batches():
            for _, data, offsets in pieces(batch, "text", limit=STEP):
                h, bounds = shingle_hashes(data, offsets, width)
                sets += [np.unique(h[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        order = np.argsort([len(s) for s in sets], kind="stable")
        own, ids, labels, sets = own[order], ids[order], Labels(np.arange(len(ids))), [sets[k] for k in order.tolist()]
        us, vs = [], []
        for start, stop, lo, near, ok in Maps([bitmap(s).tobytes() for s in sets]).allowed(np.array([len(s) for s in sets], np.int64), threshold):
            if a != b:
                ok &= own[start:stop, None] != own[None, lo : lo + ok.shape[1]]
            for x in np.flatnonzero(ok.any(axis=1)).tolist():
                others = np.flatnonzero(ok[x])
                # the nearest first: what they join needs no comparison
                for y in (others[np.argsort(near[x, others], kind="stable")] + lo).tolist():
                    i = x + start
                    if labels.of[i] != labels.of[y] and similar(sets[i], sets[y], threshold):
                        labels.join(i, y)
                        us.append(int(ids[i]))
                        vs.append(int(ids[y]))
        yield _edges(us, vs)


def verified(clusters: DataFrame, docs: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """Links (u, v), a spanning forest a tile, inside clusters (cluster, id, n, doc, tag): every pair of a cluster's sets is compared.

    A tile has two chunks of at most about MEMBERS sets and SHINGLES shingles. Texts are joined in by sorting at
    every size: a broadcast of the members would only do for small tables.
    """
    chunks = clusters.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / SHINGLES)).cast("int").alias("chunks"))
    members = clusters.join(chunks, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    members = members.select("cluster", "chunks", "own", F.col("id").alias("set"), F.col("doc").alias("id"), "tag")
    rows = docs.select("id", "tag", "text").dropDuplicates(["id", "tag"]).join(members.hint("merge"), ["id", "tag"])
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = rows.select("cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "set", "text")
    tiles = tiles.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
    return tiles.mapInArrow(lambda it: _exact(it, width, threshold), "u long, v long")


def _key(id_col: str, text_col: str) -> list[Column]:
    """id (a null one as the least long) and tag, 128 bits of the text: together they name a row, whatever ids it shares."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tag = F.struct(*tags(text))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), tag.alias("tag")]


def _linked(df: DataFrame, id_col: str, text_col: str, width: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and for each set (h1, h2) that isn't empty ``first``: the least (id, tag) of its linked group."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *_key(id_col, text_col)).select("id", "text", "tag")
    shared = spark.sparkContext.broadcast(frequency_levels(docs.select("id", "text"), width))
    sets = materialise(docs.select("id", "text", "tag").mapInArrow(lambda it: _sets(it, width, threshold, shared.value), SETS), "sets")
    classes = sets.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("id", "tag")).alias("rep"))
    # a set's own number, fixed once written, names it in links: ids may be shared
    classes = materialise(classes.select("h1", "h2", F.col("rep.id").alias("doc"), F.col("rep.tag").alias("tag"), F.monotonically_increasing_id().alias("id")), "classes")
    reps = sets.withColumnRenamed("id", "doc").join(classes, ["h1", "h2", "doc", "tag"])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(sets) // 16_000_000))
    dealt = materialise(reps.select("id", "n", "prefix").mapInArrow(lambda it: _tokens(it, buckets), "bucket int, packed binary, grp long, id long, n int"), "tokens")
    ordinary = dealt.where("bucket >= 0").select("bucket", "packed").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_groups, "grp long, id long, n int")
    groups = materialise(ordinary.unionByName(dealt.where("bucket < 0").select("grp", "id", "n")).distinct(), "groups")
    discard(dealt)
    p, q = threshold.numerator, threshold.denominator
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(q / p))).cast("int")
    banded = groups.withColumn("band", band)
    heads = banded.groupBy("grp", "band").agg(F.min(F.struct("n", "id")).alias("head")).select("grp", "band", F.col("head.n").alias("m"), F.col("head.id").alias("u"))
    both = heads.unionByName(heads.withColumn("band", F.col("band") + 1))
    star = banded.join(both, ["grp", "band"]).where(f"u != id AND least(m, n) * {q} >= greatest(m, n) * {p}")
    star = star.groupBy(F.col("u"), F.col("id").alias("v")).agg(F.max("n").alias("n"), F.max("m").alias("m"))
    marks = materialise(reps.select("id", "n", "doc", "tag", "bits").dropDuplicates(["id"]), "marks")
    bits = marks.select("id", "bits")
    star = star.join(bits.select(F.col("id").alias("u"), F.col("bits").alias("left")), "u").join(bits.select(F.col("id").alias("v"), F.col("bits").alias("right")), "v")
    star = star.select("u", "v", "n", "m", "left", "right").mapInArrow(lambda it: _possible(it, threshold), "u long, v long")
    star = materialise(star, "star")
    found = components(star, "first")
    placed = groups.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_groups = placed.groupBy("grp").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.ceil(F.count("*") / TILE).cast("int").alias("chunks")).where("c0 != c1").select("grp", "chunks")
    rest = placed.join(open_groups, "grp").join(bits, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # a group of one tile isn't banded; in others a set stands in its own band's tiles and the next one's
    rest = rest.withColumn("band", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(-1))).otherwise(F.array(band, band + 1)))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = rest.select("grp", "band", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "component", "n", "bits")
    tiles = tiles.repartition("grp", "band", "a", "b").sortWithinPartitions("grp", "band", "a", "b")
    allowed = materialise(star.unionByName(tiles.mapInArrow(lambda it: _tiles(it, threshold), "u long, v long")), "allowed")
    # every pair that may be linked is inside one cluster of allowed pairs, so each set's text is fetched once
    clusters = components(allowed, "clusters").withColumnRenamed("node", "id").withColumnRenamed("component", "cluster").join(marks.select("id", "n", "doc", "tag"), "id")
    clusters = materialise(clusters, "clusters")
    for done in (groups, star, allowed):
        discard(done)
    links = materialise(verified(clusters, docs, width, threshold), "links")
    final = components(links, "final")
    reps = classes.select("id", F.struct(F.col("doc").alias("id"), "tag").alias("rep"))
    placed = final.withColumnRenamed("node", "id")
    firsts = placed.join(reps, "id").groupBy("component").agg(F.min("rep").alias("first"))
    placed = placed.join(firsts, "component").select("id", "first")
    known = classes.select("h1", "h2", "id", F.struct(F.col("doc").alias("id"), "tag").alias("rep")).join(placed, "id", "left")
    return sets, known.select("h1", "h2", F.coalesce("first", "rep").alias("first"))


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every text; linked texts have Jaccard similarity >= ``threshold``.

    A null text and one without words have no shingles and link with nothing; one with fewer words than
    ``width`` has its whole sequence as the only shingle. Equal sets are linked. Rows that share an id link each
    by its own text; a null id is below all others and its component is null where it is the smallest; an
    empty table gives no rows; other columns are ignored.
    """
    sets, known = _linked(df, id_col, text_col, width, threshold)
    out = sets.select("id", "n", "h1", "h2").join(known.select("h1", "h2", F.col("first.id").alias("component")), ["h1", "h2"], "left")
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(own.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(component != NO_ID, component).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows, all columns as they are, of the smallest id of each group of linked texts, one row a group.

    Null and repeated ids are no link: rows that share one stay if their texts aren't linked. Rows without words
    link with nothing; those of one id and text count as one.
    """
    sets, known = _linked(df, id_col, text_col, width, threshold)
    kept = known.select("first.id", "first.tag").unionByName(sets.where("n = 0").select("id", "tag")).distinct()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_key(id_col, text_col))
    return rows.join(kept.hint("merge"), ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"]).select("row.*")
