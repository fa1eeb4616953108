"""Finding every place where a window of units (bytes or words) occurs more than once, without shuffling texts.

Each window of ``size`` units has one anchor: of the ``reach`` positions it begins with, the one whose following
``core`` units (size - reach + 1, so they are inside the window) come first in a hashed order. The anchor depends
on the window's content alone, so equal windows have equal anchors and equal cores; windows around a core that
occurs once need no further look. An anchor owns a range of window starts; ``f`` is the hash of its core and
``e`` of all the units its windows span.

Anchors travel packed: a task sends, for each bucket of ``f``, one row with the distinct ``f`` it has seen, and
what it has seen twice itself it passes on at once beside a single marker, so a very frequent core costs a
bucket one entry for each task and step, not one for each occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import CLEAR, binary, input_bytes, materialise, mix, pieces, ragged, runs, tags, task

BASE1, BASE2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
FLUSH, STEP = 100_000, 400_000
NO_ID = -(2**63)


@dataclass(frozen=True)
class Unit:
    """What a text is a sequence of, and the windows that are looked for."""

    words: bool
    size: int
    reach: int

    @property
    def core(self) -> int:
        return self.size - self.reach + 1


# ---------------------------------------------------------------- hashing


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


CLEAR["anchors"] = [_powers.cache_clear]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64, at least ``n`` of them."""
    return _powers(base, 1 << max(16, (n - 1).bit_length()))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Sums:
    """Prefix sums of letter * base^i: the hash of any range in constant time."""

    def __init__(self, letters: np.ndarray, base: int):
        up, self.down = powers(base, len(letters) + 1)
        self.at = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(letters * up[: len(letters)], out=self.at[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.at[end] - self.at[start]) * self.down[start])

    def all(self, k: int) -> np.ndarray:
        """Hashes of every range of ``k`` letters."""
        n = len(self.at) - k
        return mix((self.at[k:] - self.at[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word of several texts, and where each text's words begin in these lists."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = True
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return start, end, np.searchsorted(start, offsets)


def letters_of(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit letter for each unit, and the texts' bounds in units."""
    letters = _BYTES[data]
    if not unit.words:
        return letters, offsets
    start, end, bounds = word_bounds(data, offsets)
    return Sums(letters, BASE2).of(start, end) ^ mix((end - start).astype(np.uint64)), bounds


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def find_anchors(letters: np.ndarray, bounds: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Text number, anchor, first and last window start (all in units of the step), f and e of every anchor."""
    none = np.zeros(0, np.int64)
    count = np.diff(bounds) - unit.size + 1
    own = np.flatnonzero(count > 0)
    if not len(own):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = Sums(letters, BASE1)
    core = sums.all(unit.core)
    bits = np.uint64(max(1, int(len(core)).bit_length()))
    order = core >> bits
    lowest = sliding_min(order << bits | np.arange(len(core), dtype=np.uint64), unit.reach)
    starts = ragged(bounds[own], count[own])
    text = np.repeat(own, count[own])
    at = (lowest[starts] & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    low, high = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    p = at[first]
    e = Sums(letters, BASE2).of(low, high + unit.size) ^ mix((p - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64))
    return text[first], p, low, high, core[p], mix(e)


# ---------------------------------------------------------------- packed exchange

_FIELDS = (("f", np.uint64), ("e", np.uint64), ("id", np.int64), ("t1", np.int64), ("t2", np.int64), ("back", np.int32), ("ahead", np.int32), ("count", np.int32))
#: Hashes travel in 48 bits: a setting is told from others by 96 bits, and a core's chance namesake only costs a look.
HASH = np.uint64((1 << 48) - 1)
OCCURRENCES = "f long, e long, id long, t1 long, t2 long, back int, ahead int, positions array<long>"

#: What names a row: its id and 128 bits of its text.
NAME = ("id", "t1", "t2")

Rows = dict[str, np.ndarray]
"""Columns by name, one row for each core, setting and text; ``positions`` has each row's ``count`` positions in turn."""


def _take(rows: Rows, own: np.ndarray) -> Rows:
    first = np.cumsum(rows["count"], dtype=np.int64) - rows["count"]
    return {k: rows[k][own] for k, _ in _FIELDS} | {"positions": rows["positions"][ragged(first[own], rows["count"][own].astype(np.int64))]}


def _join(parts: list[Rows]) -> Rows:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _planes(x: np.ndarray) -> bytes:
    """Byte planes: the high bytes of small numbers then compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, at: int, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n)


def _pack(rows: Rows) -> bytes:
    n, raw = len(rows["f"]), b"".join(_planes(rows[k].astype(t)) for k, t in _FIELDS) + _planes(rows["positions"].astype(np.int64))
    return n.to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> Rows:
    n, size = (int.from_bytes(packed[k : k + 8], "little") for k in (0, 8))
    raw, at, out = pa.decompress(packed[16:], size, codec="zstd", asbytes=True), 0, {}
    for k, t in _FIELDS:
        out[k] = _from_planes(raw, at, n, t)
        at += n * np.dtype(t).itemsize
    return out | {"positions": _from_planes(raw, at, (size - at) // 8, np.int64)}


def _collapse(text: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, f: np.ndarray, e: np.ndarray, bounds: np.ndarray, names: list[np.ndarray]) -> Rows:
    """One row for all places where a text has the same core in the same setting."""
    order = np.lexsort((p, e, f, text))
    text, p, low, high, f, e = (x[order] for x in (text, p, low, high, f, e))
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (e[1:] != e[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    own = text[first]
    return {
        "f": f[first] & HASH, "e": e[first] & HASH, **{k: v[own] for k, v in zip(NAME, names, strict=True)}, "back": (p - low)[first].astype(np.int32), "ahead": (high - p)[first].astype(np.int32),
        "count": np.diff(np.append(first, len(f))).astype(np.int32), "positions": p - bounds[text],
    }


def _repeats(rows: Rows, order: np.ndarray, across: bool, known: np.ndarray) -> np.ndarray:
    """Which runs of one core in ``order`` (sorted by f and name) are repeats, as a mask over ``order``: the core is in two texts
    or (not ``across``) twice in one, or somebody else has it too (``known``)."""
    f = rows["f"][order]
    new = np.ones(len(order), bool)
    new[1:] = f[1:] != f[:-1]
    weight = rows["count"][order].astype(np.int64)
    if across:
        other = new.copy()
        for k in NAME:
            value = rows[k][order]
            other[1:] |= value[1:] != value[:-1]
        weight = other.astype(np.int64)
    first = np.flatnonzero(new)
    enough = np.add.reduceat(weight + 2 * known[order], first) > 1
    return np.repeat(enough, np.diff(np.append(first, len(order))))


def _flush(parts: list[Rows], buckets: int, turn: int, across: bool) -> Iterator[tuple[int, bool, bytes]]:
    rows = _join(parts)
    n = len(rows["f"])
    order = np.lexsort((rows["t2"], rows["t1"], rows["id"], rows["f"]))
    twice = _repeats(rows, order, across, np.zeros(n, np.int64))
    direct = np.sort(order[twice])
    step = -(-len(direct) // 5_000) or 1
    for k in range(step):
        own = direct[k::step]
        if len(own):
            yield (turn * 7919 + k) % buckets, True, _pack(_take(rows, own))
    # of what is known to repeat, the first row stands for all, without places
    f = rows["f"][order]
    head = np.ones(n, bool)
    head[1:] = f[1:] != f[:-1]
    marker = order[twice & head]
    first = np.cumsum(rows["count"], dtype=np.int64) - rows["count"]
    gone = np.zeros(len(rows["positions"]), bool)
    gone[ragged(first[marker], rows["count"][marker].astype(np.int64))] = True
    rows["positions"] = rows["positions"][~gone]
    rows["count"][marker] = 0
    sent = np.sort(order[~twice | head])
    bucket = (rows["f"][sent] >> np.uint64(20)) % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    sent, bucket = sent[by], bucket[by]
    # taken once and then sliced: a large table has many buckets, and each would else look at the whole step
    rows = _take(rows, sent)
    place = np.append(0, np.cumsum(rows["count"], dtype=np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(bucket[a]), False, _pack({k: rows[k][a:b] for k, _ in _FIELDS} | {"positions": rows["positions"][place[a] : place[b]]})


@task("anchors")
def _send(batches: Iterator[pa.RecordBatch], unit: Unit, buckets: int, across: bool) -> Iterator[pa.RecordBatch]:
    parts: list[Rows] = []
    held, turn = 0, TaskContext.get().partitionId() * 101

    def rows() -> Iterator[pa.RecordBatch]:
        out = list(_flush(parts, buckets, turn, across))
        for k in range(0, len(out), 16):
            some = out[k : k + 16]
            yield pa.record_batch([pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.bool_()), pa.array([r[2] for r in some], pa.binary())], names=["bucket", "direct", "packed"])

    for batch in batches:
        for part, data, offsets in pieces(batch, limit=STEP):
            letters, bounds = letters_of(data, offsets, unit)
            found = find_anchors(letters, bounds, unit)
            if not len(found[0]):
                continue
            parts.append(_collapse(*found, bounds, [part.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3)]))
            held += len(parts[-1]["f"])
            if held >= FLUSH:
                yield from rows()
                parts.clear()
                held, turn = 0, turn + 1
    if parts:
        yield from rows()


@task("anchors")
def _repeated(batches: Iterator[pa.RecordBatch], across: bool) -> Iterator[pa.RecordBatch]:
    """Occurrences whose core another task or step has too, and those that came as known repeats."""

    def emit(c: Rows, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keep), 50_000):
            own = _take(c, keep[k : k + 50_000])
            offsets = np.zeros(len(own["f"]) + 1, np.int32)
            np.cumsum(own["count"], out=offsets[1:])
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(own["positions"]))
            yield pa.record_batch([pa.array(own["f"].view(np.int64)), pa.array(own["e"].view(np.int64)), *(pa.array(own[x]) for x in (*NAME, "back", "ahead")), places], names=["f", "e", *NAME, "back", "ahead", "positions"])

    for group in runs(batches, 1):
        parts = []
        for direct, packed in zip(group.column(1), group.column(2), strict=True):
            c = _unpack(packed.as_py())
            if direct.as_py():
                yield from emit(c, np.arange(len(c["f"])))
            else:
                parts.append(c)
        if not parts:
            continue
        c = _join(parts)
        order = np.lexsort((c["t2"], c["t1"], c["id"], c["f"]))
        marker = c["count"] == 0
        keep = np.sort(order[_repeats(c, order, across, marker.astype(np.int64))])
        yield from emit(c, keep[~marker[keep]])


def keyed(df: DataFrame, id_col: str, text_col: str, columns: list[str] | None = None) -> DataFrame:
    """id (a null one as the least long), text, t1, t2, and the named columns beside them as one struct ``row``, so that no names clash.

    An id that no two rows have names a row alone. Only if any id repeats, null ones included, do t1 and t2 hold 128
    bits of the text; else they are zeros, which cost nothing in shuffles and tables.
    """
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(text_col), F.lit(""))
    alone = df.select(key.alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    names = [F.lit(0).cast("long").alias(c) for c in NAME[1:]] if alone else tags(text)
    rest = [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")] if columns is not None else []
    return df.select(key.alias("id"), text.alias("text"), *names, *rest)


def occurrences(docs: DataFrame, unit: Unit, across: bool) -> DataFrame:
    """Every anchor whose core occurs more than once (``across``: in more than one text), one row for each core, setting and
    text; positions, back and ahead in units of the text."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // 4_000_000))
    sent = docs.mapInArrow(lambda it: _send(it, unit, buckets, across), "bucket int, direct boolean, packed binary")
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda it: _repeated(it, across), OCCURRENCES)


# ---------------------------------------------------------------- from anchors to spans of texts


_CLASS = ("f", "e", "back", "copies", "least", "rivals")
SNIPPETS = "f long, e long, back int, copies long, least long, rivals long, units binary"
WINDOWS = "f long, e long, windows array<struct<first:int,last:int,least:long>>"
_RANGE = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("least", pa.int64())])


@task("anchors")
def _snippets(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """For each class its representative's units: bytes as they are, words as 64-bit letters."""
    for batch in batches:
        for part, data, offsets in pieces(batch, limit=STEP):
            wanted = part.column(1)
            flat = wanted.flatten()
            if not len(flat):
                continue
            field = lambda k: flat.field(k).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            row = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            units, bounds = (data, offsets) if not unit.words else letters_of(data, offsets, unit)
            start = bounds[row] + field("pos") - field("back")
            end = bounds[row] + field("pos") + field("ahead") + unit.size
            for k in range(0, len(start), 4096):
                cut = [units[a:b].tobytes() for a, b in zip(start[k : k + 4096].tolist(), end[k : k + 4096].tolist(), strict=True)]
                yield pa.record_batch([*(flat.field(c).slice(k, 4096) for c in _CLASS), pa.array(cut, pa.binary())], names=[*_CLASS, "units"])


_LONGER = "f long, e long, back int, copies long, least long, units binary, f0 long, e0 long, at int"


@task("anchors")
def _longer(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """The snippets' windows under the longer cores of ``unit``, with their first core and setting and their place beside it.

    Snippets of one core have most longer cores in common: units come with the first row of a core and setting in a
    step alone, and are null in the others.
    """
    names = ["f", "e", "back", "copies", "least", "units", "f0", "e0", "at"]
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            raw, offsets = binary(part.column(6))
            units, bounds = (raw.view(np.uint64), offsets // 8) if unit.words else (raw, offsets)
            text, p, low, high, f, e = find_anchors(units if unit.words else _BYTES[units], bounds, unit)
            f, e = f & HASH, e & HASH
            order = np.lexsort((e, f))
            new = np.ones(len(f), bool)
            new[1:] = (f[order][1:] != f[order][:-1]) | (e[order][1:] != e[order][:-1])
            head = set(order[new].tolist())
            cut = [units[a:b].tobytes() if j in head else None for j, (a, b) in enumerate(zip(low.tolist(), (high + unit.size).tolist(), strict=True))]
            f0, e0, back, copies, least = (part.column(c).to_numpy()[text] for c in range(5))
            at = (p - bounds[text] - back).astype(np.int32)
            cols = [*map(pa.array, (f.view(np.int64), e.view(np.int64), (p - low).astype(np.int32), copies, least)), pa.array(cut, pa.binary()), *map(pa.array, (f0, e0, at))]
            for j in range(0, len(f), 20_000):
                yield pa.RecordBatch.from_arrays([c.slice(j, 20_000) for c in cols], names=names)


@task("anchors")
def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, e, windows) with windows that follow each other and have one smallest id as one range."""
    for batch in batches:
        column = batch.column(2)
        flat, outer = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
        first, last, least = (flat.field(c).to_numpy() for c in ("first", "last", "least"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(outer))
        order = np.lexsort((first, least, row))
        row, first, last, least = row[order], first[order], last[order], least[order]
        head = np.ones(len(row), bool)
        head[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1]) | (first[1:] > last[:-1] + 1)
        at = np.flatnonzero(head)
        ends = np.maximum.reduceat(last, at) if len(at) else last
        offsets = np.searchsorted(row[at], np.arange(batch.num_rows + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(first[at]), pa.array(ends), pa.array(least[at])], fields=list(_RANGE))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["f", "e", "windows"])


def _rivals(classes: DataFrame) -> tuple[DataFrame, int]:
    """The classes with the number of settings of their core, and the largest such number."""
    counts = classes.groupBy("f").agg(F.count("*").alias("rivals"))
    return classes.join(counts, "f"), counts.agg(F.max("rivals")).first()[0] or 0


Solver = Callable[[DataFrame], DataFrame]


def resolve(snippets: DataFrame, most: int, unit: Unit, solve: Solver, limit: int) -> DataFrame:
    """The repeated windows of every (f, e) among distinct snippets, see ``WINDOWS``.

    ``solve`` looks at all snippets of a core in one task. A core of more than ``limit`` settings is too much for
    one: the windows around it are parted by longer cores, at last by cores as long as a window, which have one
    setting each, and solved there in the same way; the answers go back to the snippets they came from.
    """
    if most <= limit or unit.reach == 1:
        return solve(snippets)
    snippets = materialise(snippets, "snippets")
    longer = replace(unit, reach=max(1, unit.reach // 8))
    hot = snippets.where(F.col("rivals") > limit).sortWithinPartitions("f")
    parted = materialise(hot.mapInArrow(lambda it: _longer(it, longer), _LONGER), "longer")
    classes = parted.groupBy("f", "e").agg(F.first("back").alias("back"), F.sum("copies").alias("copies"), F.min("least").alias("least"), F.first("units", ignorenulls=True).alias("units"))
    classes, again = _rivals(materialise(classes, "longer-classes"))
    told = materialise(resolve(classes.select(*_CLASS, "units"), again, longer, solve, limit), "longer-windows")
    shifted = F.transform("windows", lambda w: F.struct((w["first"] + F.col("at")).alias("first"), (w["last"] + F.col("at")).alias("last"), w["least"].alias("least")))
    back = parted.select("f", "e", "f0", "e0", "at").join(told, ["f", "e"]).select(F.col("f0").alias("f"), F.col("e0").alias("e"), shifted.alias("windows"))
    # the windows of one snippet: no more than the first core's reach
    back = back.groupBy("f", "e").agg(F.flatten(F.collect_list("windows")).alias("windows")).mapInArrow(_ranged, WINDOWS)
    return solve(snippets.where(F.col("rivals") <= limit)).unionByName(back)


def spans(docs: DataFrame, unit: Unit, solve: Solver, limit: int, earlier_only: bool, lone: bool) -> DataFrame:
    """(id, t1, t2, spans) of every text with something to remove; a span has positions and the windows around each, see ``ranges``.

    ``solve`` gets the distinct snippets around the cores that repeat and returns for each (f, e) an array of (first,
    last, least): windows, counted from the anchor, that occur more than once, with the smallest id that has them.
    With ``lone`` it also gets the cores that always have the same setting; otherwise their windows, of which each
    occurrence has all, need no structure: they repeat as often as the setting does. ``earlier_only`` keeps windows
    that a smaller id has elsewhere; otherwise any repeat counts.
    """
    found = materialise(occurrences(docs, unit, earlier_only), "occurrences")
    # first by core and setting, which the map side combines, so that a frequent core's occurrences never meet in one task
    first = [F.first(c).alias(c) for c in (*NAME, "back", "ahead")]
    classes = found.groupBy("f", "e").agg(F.sum(F.size("positions")).alias("copies"), F.min("id").alias("least"), F.first(F.get("positions", F.lit(0))).alias("pos"), *first)
    classes, most = _rivals(materialise(classes, "classes"))
    wanted = classes if lone else classes.where("rivals > 1")
    wanted = wanted.groupBy(*NAME).agg(F.collect_list(F.struct("f", "e", "pos", "back", "ahead", "copies", "least", "rivals")).alias("wanted"))
    cut = docs.select(*NAME, "text").join(wanted, [*NAME]).select("text", "wanted").mapInArrow(lambda it: _snippets(it, unit), SNIPPETS)
    told = materialise(resolve(cut, most, unit, solve, limit), "resolved")
    if not lone:
        whole = F.array(F.struct((-F.col("back")).alias("first"), F.col("ahead").alias("last"), "least"))
        told = told.unionByName(classes.where("rivals = 1 AND copies > 1").select("f", "e", whole.alias("windows")))
    hit = found.select("f", "e", *NAME, "positions").join(told, ["f", "e"])
    if earlier_only:
        hit = hit.withColumn("windows", F.filter("windows", lambda w: w["least"] < F.col("id"))).where(F.size("windows") > 0)
    windows = F.transform("windows", lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last")))
    # the spans of one text: no more than its length has room for
    return hit.groupBy(*NAME).agg(F.collect_list(F.struct("positions", windows.alias("windows"))).alias("spans"))


def ranges(column: pa.ListArray, size: int) -> list[tuple[list[int], list[int]]]:
    """For each row of a ``spans`` column the merged ranges of units that its windows of ``size`` cover."""
    n = len(column)
    out: list[tuple[list[int], list[int]]] = [([], [])] * n
    outer = column.offsets.to_numpy()
    flat = column.values.slice(outer[0], outer[-1] - outer[0])
    if not len(flat):
        return out
    places, windows = flat.field("positions"), flat.field("windows")
    p_at, w_at = places.offsets.to_numpy()[: len(flat) + 1], windows.offsets.to_numpy()[: len(flat) + 1]
    positions = places.values.to_numpy()
    first, last = (windows.values.field(k).to_numpy() for k in ("first", "last"))
    per, many = np.diff(p_at), np.diff(w_at)
    total = (per * many).astype(np.int64)
    entry = np.repeat(np.arange(len(flat)), total)
    within = np.arange(len(entry)) - np.repeat(np.cumsum(total) - total, total)
    at = positions[p_at[entry] + within // many[entry]]
    w = w_at[entry] + within % many[entry]
    start, end = at + first[w], at + last[w] + size
    row = np.repeat(np.arange(n), np.diff(outer))[entry]
    cuts = np.searchsorted(row, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        out[k] = merge(start[cuts[k] : cuts[k + 1]], end[cuts[k] : cuts[k + 1]])
    return out


def merge(start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of ranges; ranges that touch become one."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist()
