"""Byte-level deduplication with suffix arrays built by linear grouping.

``build`` sorts the suffixes of many strings at once. Phase one keeps suffixes in groups by a growing Lyndon
prefix and takes the groups in descending order: the members of the current group are removed from a linked
list of text positions, so the left neighbour of a run of members is their previous smaller suffix, and the
position's own group is split by how many members hang on it. Phase two goes through the finished groups in
ascending order and emits each group's order from the already final rank of the suffix behind its prefix; no
names are given and nothing recurses. All strings take a step together, as one numpy step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.anchors import NAME, NO_ID, WINDOWS, Solver, Unit, keyed, ranges, spans
from pagemill.llm.common import ragged, runs, task

LENGTH, REACH = 200, 128
#: Settings of one core that one array holds, more are parted by longer cores; bytes of a step.
RIVALS, BATCH = 1024, 250_000


def build(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings symbols[bounds[k]:bounds[k + 1]], one after the other, as positions in ``symbols``.

    Symbols are non-negative integers; a suffix that is a prefix of another of its string comes first.
    """
    lengths = np.diff(bounds)
    count = len(lengths)
    # each string gets a head below everything (left end of its list) and a tail below all its symbols
    size = lengths + 2
    off = np.zeros(count + 1, np.int64)
    np.cumsum(size, out=off[1:])
    n = int(off[-1])
    s = np.zeros(n, np.int64)
    body = ragged(off[:-1] + 1, lengths)
    s[body] = symbols.astype(np.int64) + 2
    s[off[1:] - 1] = 1
    owner = np.repeat(np.arange(count), size)
    sa = np.argsort(owner * (int(s.max(initial=1)) + 1) + s, kind="stable")
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    key = s[sa] + owner[sa] * (int(s.max(initial=1)) + 1)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    sizes = np.zeros(n + 1, np.int64)
    sizes[starts] = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(starts, sizes[starts])
    left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
    left[0] = 0
    behind = np.zeros(n, np.int64)  # where a suffix's Lyndon prefix ends
    mark = np.zeros(n, bool)
    top, floor = off[1:].copy(), off[:-1] + 1  # the head's own group stays
    active = np.flatnonzero(top > floor)
    steps: list[np.ndarray] = []
    while len(active):
        end = top[active]
        begin = group[sa[end - 1]]
        top[active] = begin
        several = begin < end - 1
        if several.any():
            steps.append(np.stack([begin[several], end[several] - begin[several]]))
            m = np.sort(sa[ragged(begin, end - begin)])
            head = np.ones(len(m), bool)
            head[1:] = left[m[1:]] != m[:-1]
            behind[m] = right[m]
            h = np.flatnonzero(head)
            run = np.diff(np.append(h, len(m)))
            p, q = left[m[h]], right[m[h + run - 1]]
        else:
            m = sa[begin]
            behind[m] = right[m]
            run = None
            p, q = left[m], right[m]
        right[p] = q
        inside = q < n
        left[q[inside]] = p[inside]
        inner = p != off[owner[p]]
        p = p[inner]
        if len(p):
            g = group[p]
            run = run[inner] if run is not None else None
            order = np.argsort(g, kind="stable") if run is None else np.lexsort((run, g))
            p, g = p[order], g[order]
            first = np.ones(len(p), bool)
            first[1:] = g[1:] != g[:-1]
            f = np.flatnonzero(first)
            movers = np.diff(np.append(f, len(p)))
            gs = g[f]
            boundary = gs + sizes[gs] - movers
            slot = ragged(boundary, movers)
            if run is not None:
                r = run[order]
                first[1:] |= r[1:] != r[:-1]
                f = np.flatnonzero(first)
            cls = slot[f]
            old = isa[p]
            limit = np.repeat(boundary, movers)
            mark[p] = True
            there = sa[slot]
            displaced = there[~mark[there]]
            mark[p] = False
            vacated = old[old < limit]
            sa[vacated] = displaced
            isa[displaced] = vacated
            sa[slot] = p
            isa[p] = slot
            sizes[gs] -= movers
            amount = np.diff(np.append(f, len(p)))
            sizes[cls] = amount
            group[p] = np.repeat(cls, amount)
        active = active[begin > floor[active]]
    # phase two: ascending groups, only those with several members have an order to find
    for begin, amount in reversed(steps):
        slots = ragged(begin, amount)
        m = np.sort(sa[slots])
        which = np.repeat(np.arange(len(begin)), amount)
        # positions ascend with strings and so with the order of ``begin``'s strings
        by = np.argsort(begin, kind="stable")
        which, slots = np.repeat(by, amount[by]), ragged(begin[by], amount[by])
        last = np.ones(len(m), bool)
        last[:-1] = behind[m[:-1]] != m[1:]
        ends = np.flatnonzero(last)
        run = np.diff(np.append(-1, ends))
        depth = np.repeat(ends, run) - np.arange(len(m))
        rank = np.repeat(isa[behind[m[ends]]], run)
        order = np.lexsort((rank, depth, which)) if depth.any() else np.lexsort((rank, which))
        # ``which`` was only needed to keep strings apart; sorted positions are already grouped by string
        sa[slots] = m[order]
        isa[m[order]] = slots
    place = np.zeros(n, bool)
    place[body] = True
    out = sa[place[sa]]
    return out - 2 * owner[out] - 1


def repeats(snippets: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of several distinct snippets of one group, the starts whose next ``length`` bytes start elsewhere in the group too."""
    return repeats_of_groups([snippets], length)[0]


def repeats_of_groups(groups: list[list[bytes]], length: int = LENGTH) -> list[list[np.ndarray]]:
    """``repeats`` for many groups at once: one string a group, snippets parted by a symbol below all bytes."""
    flat = [x for g in groups for x in g]
    text = np.frombuffer(b"".join(flat), np.uint8)
    lens = np.array([len(x) for x in flat], np.int64)
    base = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(lens + 1, out=base[1:])
    symbols = np.zeros(int(base[-1]), np.int64)
    symbols[ragged(base[:-1], lens)] = text.astype(np.int64) + 1
    per = np.array([len(g) for g in groups], np.int64)
    bounds = base[np.append(0, np.cumsum(per))]
    sa = build(symbols, bounds)
    whole = np.zeros(len(symbols), bool)  # starts with ``length`` bytes left in their snippet
    whole[ragged(base[:-1], np.maximum(lens - length + 1, 0))] = True
    ranks = sa[whole[sa]]
    string = np.searchsorted(bounds, ranks, side="right")
    same = np.zeros(len(ranks) + 1, bool)
    # windows are inside snippets, so eight bytes at a time can be compared, the last eight overlapping
    raw = np.zeros(len(symbols) + 8, np.uint8)
    raw[ragged(base[:-1], lens)] = text
    eight = np.ndarray((len(symbols) + 1,), "<u8", raw, strides=(1,)) if length >= 8 else raw
    step = 8 if length >= 8 else 1
    offsets = np.append(np.arange(0, length - step, step), length - step)
    for k in range(0, max(len(ranks) - 1, 0), 20_000):
        a, b = ranks[k : k + 20_000], ranks[k + 1 : k + 20_001]
        a = a[: len(b)]
        near = string[k : k + len(a)] == string[k + 1 : k + 1 + len(a)]
        near &= eight[a] == eight[b]
        own = np.flatnonzero(near)
        equal = (eight[a[own][:, None] + offsets] == eight[b[own][:, None] + offsets]).all(axis=1)
        same[k + 1 + own] = equal
    hit = np.sort(ranks[same[1:] | same[:-1]])
    cuts = np.searchsorted(hit, base)
    each = [hit[cuts[k] : cuts[k + 1]] - base[k] for k in range(len(flat))]
    at, out = 0, []
    for n in per:
        out.append(each[at : at + n])
        at += n
    return out


def _ranges(starts: np.ndarray, back: int) -> list[dict]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    first, last = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
    return [{"first": int(a) - back, "last": int(b) - back, "least": NO_ID} for a, b in zip(first, last, strict=True)]


@task("anchors")
def _resolve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Groups of snippets with one core, many groups of similar size to a build."""
    held: list[dict] = []
    size = 0

    def solve() -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(held)), key=lambda k: sum(map(len, held[k]["units"])))
        at = 0
        while at < len(order):
            end, total, least = at, 0, sum(map(len, held[order[at]]["units"]))
            while end < len(order) and (end == at or (total < BATCH and sum(map(len, held[order[end]]["units"])) <= 2 * least + 64)):
                total += sum(map(len, held[order[end]]["units"]))
                end += 1
            own = [held[k] for k in order[at:end]]
            at = end
            f, e, windows = [], [], []
            for g, hits in zip(own, repeats_of_groups([g["units"] for g in own], length), strict=True):
                for k, starts in enumerate(hits):
                    if g["copies"][k] > 1:  # all of its windows occur in each copy
                        starts = np.arange(len(g["units"][k]) - length + 1)
                    f.append(g["f"][k])
                    e.append(g["e"][k])
                    windows.append(_ranges(starts, g["back"][k]))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("least", pa.int64())]))
            yield pa.record_batch([pa.array(f, pa.int64()), pa.array(e, pa.int64()), pa.array(windows, kind)], names=["f", "e", "windows"])

    for group in runs(batches, 1):
        held.append({k: group.column(k).to_pylist() for k in ("f", "e", "back", "copies", "units")})
        size += sum(map(len, held[-1]["units"]))
        if size >= 4 * BATCH:
            yield from solve()
            held, size = [], 0
    if held:
        yield from solve()


def solver(length: int = LENGTH) -> Solver:
    """How ``spans`` finds repeated windows: a suffix array for each core."""
    return lambda snippets: snippets.repartition("f").sortWithinPartitions("f").mapInArrow(lambda it: _resolve(it, length), WINDOWS)


def _spans(docs: DataFrame, length: int) -> DataFrame:
    unit = Unit(words=False, size=length, reach=max(1, min(REACH, length * 16 // 25)))
    return spans(docs, unit, solver(length), RIVALS, earlier_only=False, lone=False)


@task("anchors")
def _apply(batches: Iterator[pa.RecordBatch], length: int, keep: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if keep else [])]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for ident, text, (s, e) in zip(batch.column(0), batch.column(1), ranges(batch.column(2), length), strict=True):
            raw = text.as_py().encode("utf-8")
            cut: list[bytes] = []
            at = 0
            for a, b in zip(s, e, strict=True):
                cut.append(raw[at:a])
                at = b
            cut.append(raw[at:])
            kept = b"".join(cut)
            doc = ident.as_py()
            values = (None if doc == NO_ID else doc, len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
            for col, v in zip(rows, values, strict=False):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=False)], names=names)


def dedup_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (``keep_text``) text without its repeated bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in any text. Null texts
    are empty; texts shorter than ``length`` stay whole; identical rows count as separate texts, so both lose
    what they share; rows may share an id or have none; an empty table gives no rows; other columns are ignored.
    ``text`` drops bytes of a character that was cut in two; the hash is of the exact bytes.
    """
    docs = keyed(df, id_col, text_col)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text
    return docs.join(_spans(docs, length), [*NAME], "left").select("id", "text", "spans").mapInArrow(lambda it: _apply(it, length, keep_text), schema)


@task("anchors")
def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, (s, e) in zip(batch.column(1), ranges(batch.column(2), length), strict=True):
            raw = text.as_py().encode("utf-8")
            kept.append(b"".join(raw[a:b] for a, b in zip([0, *e], [*s, len(raw)], strict=True)).decode("utf-8", "ignore"))
        yield pa.record_batch([batch.column(0), pa.array(kept, pa.string())], names=["row", "kept"])


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows with all their columns, ``text_col`` without its repeated bytes (see ``dedup_bytes``); a null text becomes empty."""
    rows = keyed(df, id_col, text_col, [c for c in df.columns if c != text_col])
    found = rows.join(_spans(rows.drop("row"), length), [*NAME], "left").select("row", "text", "spans")
    schema = T.StructType([T.StructField("row", found.schema["row"].dataType), T.StructField("kept", T.StringType())])
    cut = found.mapInArrow(lambda it: _cut(it, length), schema)
    return cut.select(*[F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])
