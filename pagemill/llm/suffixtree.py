"""Substring deduplication of words with prefix-partitioned suffix trees.

Suffixes are split by variable-length prefixes: tasks get the suffixes around one core, or a longer one where too
many share it; a prefix that too many of a task's suffixes share is extended word by word until each group fits
in memory, small groups are put together, and for each such set the subtrees are built
from their sorted leaves and the branching depths between neighbours, reading an elastic range of words at a
time: the fewer suffixes still share a branch, the more words each reads. Internal nodes at least as deep as the
window are the maximal repeats; a node knows the smallest id among its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.anchors import NAME, NO_ID, WINDOWS, Solver, Unit, keyed, ranges, spans
from pagemill.llm.common import binary, ragged, runs, task

WORDS, REACH = 13, 10
#: Suffixes that one set of subtrees holds; words all active suffixes read at once; settings of one core that one
#: task holds: more are parted by longer cores.
MEMORY, READ, RIVALS = 40_000, 400_000, 2048


def prefix_groups(x: np.ndarray, group: np.ndarray, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """Row numbers in sets of about ``memory``; suffixes of one group that share a prefix stay together.

    ``x`` has a suffix's first words in each row. Groups of more than ``memory`` rows are split by their first
    word, what is still too large by the second, and so on; rows that agree in all words can't be split.
    """
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.diff(group[order])) + 1
    pending = [(part, 0) for part in np.split(order, cut)] if len(order) else []
    held: list[np.ndarray] = []
    size = 0
    while pending:
        rows, depth = pending.pop()
        if len(rows) > memory and depth < x.shape[1]:
            by = np.argsort(x[rows, depth], kind="stable")
            rows = rows[by]
            pending += [(part, depth + 1) for part in np.split(rows, np.flatnonzero(np.diff(x[rows, depth])) + 1)]
            continue
        if size + len(rows) > memory and held:
            yield np.concatenate(held)
            held, size = [], 0
        held.append(rows)
        size += len(rows)
    if held:
        yield np.concatenate(held)


def subtrees(x: np.ndarray, group: np.ndarray, read: int = READ) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in lexicographic order within their group, and how many words each shares with the one before (-1 in another group)."""
    n, words = x.shape
    leaves = np.argsort(group, kind="stable")
    branch = np.full(n, words, np.int64)
    first = np.ones(n, bool)
    first[1:] = group[leaves][1:] != group[leaves][:-1]
    branch[first] = -1
    label = np.cumsum(first)
    depth = 0
    while depth < words:
        # a leaf is active while it shares a branch with a neighbour
        alone = np.diff(np.append(np.flatnonzero(first), n)) == 1
        active = np.flatnonzero(~np.repeat(alone, np.diff(np.append(np.flatnonzero(first), n))))
        if not len(active):
            break
        width = int(np.clip(read // len(active), 1, words - depth))
        rows = leaves[active]
        block = x[rows, depth : depth + width]
        order = np.lexsort((*[block[:, c] for c in range(width - 1, -1, -1)], label[active]))
        leaves[active] = rows[order]
        block = block[order]
        differs = block[1:] != block[:-1]
        split = differs.any(axis=1) & (label[active][1:] == label[active][:-1])
        at = active[1:][split]
        branch[at] = depth + differs[split].argmax(axis=1)
        first[at] = True
        label = np.cumsum(first)
        depth += width
    return leaves, branch


def deep_nodes(leaves: np.ndarray, branch: np.ndarray, depth: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf in order: the smallest id below its ancestor of at least ``depth`` words, and that node's leaves."""
    start = np.flatnonzero(branch < depth)
    size = np.diff(np.append(start, len(leaves)))
    return np.repeat(np.minimum.reduceat(least[leaves], start), size), np.repeat(size, size)


def repeats(x: np.ndarray, group: np.ndarray, least: np.ndarray, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix: the smallest id that has its words too (its own included), and how many leaves do."""
    smallest, size = least.copy(), np.ones(len(x), np.int64)
    for rows in prefix_groups(x, group, memory):
        leaves, branch = subtrees(x[rows], group[rows])
        low, many = deep_nodes(leaves, branch, x.shape[1], least[rows])
        smallest[rows[leaves]], size[rows[leaves]] = low, many
    return smallest, size


def _windows(units: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ``words`` words of every suffix of several snippets that has so many (a view for each place), its snippet and its place there."""
    count = np.maximum(np.diff(bounds) - words + 1, 0)
    start = ragged(bounds[:-1], count)
    owner = np.repeat(np.arange(len(count)), count)
    view = np.lib.stride_tricks.sliding_window_view(units, words) if len(units) >= words else np.zeros((0, words), np.uint64)
    return view[start], owner, start - bounds[owner]


_KIND = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("least", pa.int64())]))


def _solve(t: pa.Table, words: int) -> Iterator[pa.RecordBatch]:
    f, e, back, copies, least = (t.column(k).to_numpy() for k in range(5))
    raw, offsets = binary(t.column(6))
    x, owner, at = _windows(raw.view(np.uint64), offsets // 8, words)
    low, many = repeats(x, f[owner], least[owner])
    told = np.flatnonzero((many > 1) | (copies[owner] > 1))
    if len(told):
        owner, first, low = owner[told], (at[told] - back[owner[told]]).astype(np.int32), low[told]
        # neighbours of one snippet that the same smallest id has are one range
        head = np.append(True, (np.diff(owner) != 0) | (np.diff(first) != 1) | (np.diff(low) != 0))
        last = first[np.append(head[1:], True)]
        owner, first, low = owner[head], first[head], low[head]
        new = np.append(0, np.flatnonzero(np.diff(owner)) + 1)
        offsets = pa.array(np.append(new, len(owner)).astype(np.int32))
        values = pa.StructArray.from_arrays([pa.array(first), pa.array(last), pa.array(low)], fields=list(_KIND.value_type))
        yield pa.record_batch([pa.array(f[owner[new]]), pa.array(e[owner[new]]), pa.ListArray.from_arrays(offsets, values)], names=["f", "e", "windows"])


@task("anchors")
def _resolve(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0
    for group in runs(batches, 1):
        held.append(group)
        size += pa.compute.sum(pa.compute.binary_length(group.column(6))).as_py() // 8
        if size >= MEMORY:
            yield from _solve(pa.concat_tables(held), words)
            held, size = [], 0
    if held:
        yield from _solve(pa.concat_tables(held), words)


def solver(words: int = WORDS) -> Solver:
    """How ``spans`` finds repeated windows: subtrees of the suffixes around each core."""
    return lambda snippets: snippets.repartition("f").sortWithinPartitions("f").mapInArrow(lambda it: _resolve(it, words), WINDOWS)


@task("anchors")
def _apply(batches: Iterator[pa.RecordBatch], size: int, keep: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if keep else [])]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for ident, text, (s, e) in zip(batch.column(0), batch.column(1), ranges(batch.column(2), size), strict=True):
            # bytes.split() parts at exactly 0x20 and 0x09 to 0x0D
            words = text.as_py().encode("utf-8").split()
            kept = words
            if s:
                kept, at = [], 0
                for a, b in zip(s, e, strict=True):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
            joined, doc = b" ".join(kept), ident.as_py()
            values = (None if doc == NO_ID else doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8"))
            for col, v in zip(rows, values, strict=False):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=False)], names=names)


def dedup_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (``keep_text``) the kept words joined by one space.

    A word goes if ``words`` consecutive words that cover it also start in a text with a smaller id; the text
    with the smallest id keeps all. Null texts have no words; texts with fewer words stay whole; repeats inside
    one text, or between rows that share an id, remove nothing; a null id is below all others; an empty table
    gives no rows; other columns are ignored.
    """
    unit = Unit(words=True, size=words, reach=max(1, min(REACH, words - 3)))
    docs = keyed(df, id_col, text_col)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    return docs.join(spans(docs, unit, solver(words), RIVALS, earlier_only=True, lone=True), [*NAME], "left").select("id", "text", "spans").mapInArrow(lambda it: _apply(it, words, keep_text), schema)
