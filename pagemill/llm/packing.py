"""Pattern packing by non-negative least squares.

Every document becomes token ids and an end id, longer ones are cut into full pieces. The histogram of piece
lengths, counted over all pieces, is fitted by repeat counts of few-document patterns that fill a sequence; the
counts are rounded, filled with pieces, and what remains goes best fit into the gaps, whole runs of equal
lengths at a time. The plan is a table of (lengths, repeats) whose size depends on the sequence length alone,
so the driver never sees a document, and a piece finds its place by its ordinal among pieces of its length.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import CLEAR, id_text, materialise, task
from pagemill.llm.tokencount import NUMBERS, SPACE, Splitter, _tokenizer, byte_letters, plain, spelled

# What the tokenizer's own pre-tokeniser keeps, for code points up to PLAIN.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W_{NUMBERS}]+|[{NUMBERS}]|(?:[^\w{SPACE}]|_)+"

CAPACITY, BINS, DEPTH = 2048, 256, 3
#: Steepest patterns that may join a fit, and the unfitted share of pieces below which none does.
ROUNDS, UNFITTED = 400, 0.002
CACHE_ENTRIES = 400_000


# ---------------------------------------------------------------- the plan


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``depth`` bins that add up to ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for b in range(min(left, most), 0, -1):
                if b * (depth - len(head)) < left:
                    break
                grow((*head, b), left - b, b)

    grow((), bins, bins)
    return out


def nnls(a: np.ndarray, y: np.ndarray, rounds: int | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Least squares under x >= 0 by active sets: free the steepest variable, step back where one turns negative."""
    m, n = a.shape
    x = np.zeros(n) if start is None else start.copy()
    free = x > 0
    gradient = a.T @ (y - a @ x)
    for _ in range(rounds or 3 * m):
        candidates = np.where(~free, gradient, -np.inf)
        k = int(np.argmax(candidates))
        if candidates[k] <= 1e-9:
            break
        free[k] = True
        while True:
            idx = np.flatnonzero(free)
            own = a[:, idx]
            # columns may depend on each other: a trace of ridge keeps the small system solvable
            s = np.linalg.solve(own.T @ own + 1e-10 * np.eye(len(idx)), own.T @ y)
            if s.min() > 1e-12:
                x[:] = 0
                x[idx] = s
                break
            low = s <= 1e-12
            now = x[idx]
            step = np.min(now[low] / np.maximum(now[low] - s[low], 1e-300))
            x[idx] = now + step * (s - now)
            free[idx[x[idx] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
        gradient = a.T @ (y - a @ x)
    return x


def steepest(residual: np.ndarray, full: bool = True) -> tuple[int, ...]:
    """Of all patterns of any number of pieces that fill the bins, exactly or (not ``full``) at most, the one along which the
    fit gains most: a knapsack."""
    bins = len(residual)
    best, last = np.full(bins + 1, -np.inf), np.zeros(bins + 1, np.int64)
    best[0] = 0
    for s in range(1, bins + 1):
        gain = best[s - 1 :: -1] + residual[:s]
        last[s] = k = int(np.argmax(gain))
        best[s] = gain[k]
    out, s = [], bins if full else int(np.argmax(best))
    while s:
        out.append(int(last[s]) + 1)
        s -= out[-1]
    return tuple(sorted(out, reverse=True))


def fitted(y: np.ndarray, depth: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], float]]:
    """Patterns and their repeats, fitted to the share ``y`` of pieces in each bin.

    First all patterns of at most ``depth`` pieces. Short pieces need longer patterns, too many to list: while a
    noticeable share of pieces is unfitted, the steepest pattern of any length joins the fit; last ones that leave
    room, for pieces that nothing in the histogram could fill up.
    """
    bins = len(y)
    kinds = patterns(bins, depth)

    def column(kind: tuple[int, ...]) -> np.ndarray:
        return np.bincount(np.array(kind) - 1, minlength=bins).astype(float)

    a = np.array([column(k) for k in kinds]).T
    x = nnls(a, y)
    used = np.flatnonzero(x > 0)
    kinds, a, x = [kinds[k] for k in used], a[:, used], x[used]
    full = True
    for _ in range(rounds):
        residual = y - a @ x if len(kinds) else y
        if np.abs(residual).sum() < UNFITTED:
            break
        kind = steepest(residual if full else np.maximum(residual, 0), full)
        if kind in kinds or not kind or residual @ column(kind) < 1e-6:
            if not full:
                break
            full = False
            continue
        kinds, a, x = [*kinds, kind], np.column_stack([a, column(kind)]), np.append(x, 0.0)
        x = nnls(a, y, 1, x)
        kinds, a, x = [k for k, v in zip(kinds, x, strict=True) if v > 0], a[:, x > 0], x[x > 0]
    return list(zip(kinds, x.tolist(), strict=True))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, depth: int = DEPTH, told: dict | None = None) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces of a sequence, number of such sequences); every piece of the histogram is in one of them.

    ``told`` gets the number of pieces that patterns placed.
    """
    bins = min(bins, capacity)
    left = {n: c for n, c in histogram.items() if c > 0}
    width = -(-capacity // bins)
    total = sum(left.values())
    y = np.zeros(capacity // width)
    for n, c in left.items():
        y[-(-n // width) - 1] += c
    fit = sorted(fitted(y / max(total, 1), depth), key=lambda f: (-f[1], f[0]))
    open_by_slack: list[list[list]] = [[] for _ in range(capacity + 1)]
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        slack = capacity - sum(lengths)
        if slack:
            open_by_slack[slack].append([lengths, n])
        else:
            done.append((lengths, n))

    def repeat(kind: tuple[int, ...], repeats: int) -> None:
        while repeats > 0:
            taken, used = [], {}
            for k, b in enumerate(kind):
                # the last place takes the longest piece that still fits, so a bin's width isn't lost as a gap
                room = capacity - sum(taken)
                at = min(b * width, room) if k + 1 < len(kind) else room
                n = next((n for n in range(at, (b - 1) * width, -1) if left.get(n, 0) > used.get(n, 0)), None)
                if n is None:  # exact lengths of this bin have run out: the nearest that fits
                    n = next((n for d in range(1, width + 1) for n in (b * width + d, (b - 1) * width + 1 - d) if 0 < n <= room and left.get(n, 0) > used.get(n, 0)), None)
                if n is None:
                    return
                used[n] = used.get(n, 0) + 1
                taken.append(n)
            runs = min([repeats, *(left[n] // k for n, k in used.items())])
            for n, k in used.items():
                left[n] -= runs * k
            put(tuple(taken), runs)
            repeats -= runs

    for kind, x in fit:
        repeat(kind, int(x * total + 1e-6))
    if told is not None:
        told["by_patterns"] = total - sum(left.values())
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        count = left[n]
        while count:
            slack = next((s for s in range(n, capacity + 1) if open_by_slack[s]), None)
            if slack is not None:
                lengths, there = open_by_slack[slack][-1]
                k = min(count, there)
                if k == there:
                    open_by_slack[slack].pop()
                else:
                    open_by_slack[slack][-1][1] -= k
                put((*lengths, n), k)
                count -= k
            else:
                each = capacity // n
                full, rest = divmod(count, each)
                if full:
                    put((n,) * each, full)
                if rest:
                    put((n,) * rest, 1)
                count = 0
    return done + [(lengths, n) for row in open_by_slack for lengths, n in row if n]


def places(sequences: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """Runs of places sorted by length: (length, ordinal of the first piece of it that goes here, its sequence, offset)."""
    rows, base = [], 0
    seen: dict[int, int] = {}
    for lengths, n in sequences:
        for length, offset in zip(lengths, accumulate((0, *lengths)), strict=False):
            rows.append((length, seen.get(length, 0), base, offset))
            seen[length] = seen.get(length, 0) + n
        base += n
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(4))


# ---------------------------------------------------------------- tokens


class WordIds(dict):
    """Pre-token to packed little-endian ids of one tokenizer, kept up to a bound; the keys of ``pieces`` are in byte letters."""

    def __init__(self, path: str):
        super().__init__()
        self.splitter, self.model, self.letters = Splitter(path), _tokenizer(path).model, dict(enumerate(byte_letters()))
        self.pieces: dict[str, bytes] = {}

    def encoded(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        out = self.encoded(spelled(word, self.letters))
        if len(word) <= 64:
            if len(self) > CACHE_ENTRIES:
                self.clear()
            self[word] = out
        return out

    def piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            out = self.encoded(piece)
            if len(piece) <= 64:
                if len(self.pieces) > CACHE_ENTRIES:
                    self.pieces.clear()
                self.pieces[piece] = out
        return out

    def part(self, text: str) -> bytes:
        """The ids of a text without special strings: a plain one by pattern, any other by the library's own normaliser and pre-tokeniser."""
        if not text:
            return b""
        if plain(text) and "İ" not in text:
            return b"".join(map(self.__getitem__, _FIND(text.lower())))
        tokenizer = self.splitter.tokenizer
        normal = tokenizer.normalizer.normalize_str(text)
        return b"".join(self.piece(p) for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal))


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    return WordIds(path)


CLEAR["packing"] = [_words.cache_clear, _tokenizer.cache_clear]


def token_bytes(text: str, path: str) -> bytes:
    """The ids of a text as the tokenizer gives them, packed; a special string is one id."""
    words = _words(path)
    parts = words.splitter.parts(text)
    if len(parts) == 1:
        return words.part(text)
    found = words.splitter.cut.findall(text)
    marks = [struct.pack("<I", words.splitter.specials[s]) for s in found]
    return b"".join(words.part(p) + m for p, m in zip(parts, [*marks, b""], strict=True))


_FIND = re.compile(WORDS).findall

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


@task("packing")
def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [], [], [])
        for ident, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = token_bytes(value.as_py() or "", path) + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                own = raw[at : at + 4 * capacity]
                n = len(own) // 4
                for col, v in zip(rows, (ident, k, at // 4, n, zlib.crc32(own), part, int(seen[n])), strict=True):
                    col.append(v)
                seen[n] += 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])


def _placed(batches: Iterator[pa.RecordBatch], runs: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    length, first, sequence, offset = runs
    #: ordinals stay below 2^48 for each length, so one sorted key finds the run
    keys = length << np.int64(48) | first
    for batch in batches:
        n, nth = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        at = np.searchsorted(keys, n << np.int64(48) | nth, side="right") - 1
        cols = [batch.column(k) for k in range(5)] + [pa.array(sequence[at] + nth - first[at]), pa.array(offset[at])]
        yield pa.record_batch(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every text.

    A null or empty text is one piece of the end id alone; repeated or null ids are packed row by row; an empty
    table gives no rows; other columns are ignored. The pieces, without their ids, are written once to the
    shared folder, because their ordinals must not change. Ordinals are a per-task counter plus the earlier
    tasks' counts of the same length, so no length is gathered in one task; the broadcast plan is bounded by
    ``capacity``.
    """
    spark = df.sparkSession
    pieces = materialise(id_text(df, id_col, text_col).mapInArrow(lambda it: _pieces(it, tokenizer_path, capacity), PIECES), "pieces")
    # at most one row for each task and length
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(places(plan(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("nth"))
    return placed.mapInArrow(lambda it: _placed(it, runs.value), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
