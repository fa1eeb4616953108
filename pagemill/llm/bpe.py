"""Byte-level BPE as a monoid: encode halves, join them where they meet, decode up the same tree.

A sequence of tokens is the BPE encoding of its bytes exactly if each adjacent pair is the encoding of the
pair's own bytes. Joining two encodings therefore only re-encodes a window around the seam; the window grows
by a token on whichever side its outermost token doesn't yet stand beside the kept one as such a pair, and
once both sides do, everything outside is proven unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagemill.llm.common import CLEAR, id_text, task
from pagemill.llm.tokencount import PATTERN, PLAIN_PATTERN, plain

CACHE_ENTRIES = 300_000
#: Bytes of the smallest tree nodes, of windows merged one by one; bytes of remembered nodes of one match; tokens decoded as one node.
LEAF, FEW, REMEMBERED, BLOCK = 3, 64, 32_000_000, 256
NONE = np.iinfo(np.int64).max


class MonoidBPE:
    """The encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([c])] for c in range(256)], np.int64)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def leaf(self, data: bytes) -> tuple[int, ...]:
        """Plain BPE: merge the adjacent parts of the lowest rank, leftmost first, until none has a rank."""
        if len(data) > FEW:
            return self._by_rank(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens put together, NONE where they are no token."""
        pairs, at = np.unique(a << np.int64(32) | b, return_inverse=True)
        found = [self.ranks.get(self.vocab[p >> 32] + self.vocab[p & 0xFFFFFFFF], NONE) for p in pairs.tolist()]
        return np.array(found, np.int64)[at]

    def _by_rank(self, data: bytes) -> tuple[int, ...]:
        """``leaf`` for long windows, which are mostly runs and periods: all merges of the lowest rank are one step.

        That is the plain order as long as no step makes a pair of a lower rank than its own; if one does, the
        window goes to ``_by_heap``.
        """
        ranks = self.ranks
        tokens = self.single[np.frombuffer(data, np.uint8)]
        rank = self._pair_ranks(tokens[:-1], tokens[1:])
        while len(rank):
            low = rank.min()
            if low == NONE:
                break
            hit = np.flatnonzero(rank == low)
            # of pairs that overlap in a chain every other one, from the left
            new = np.append(True, np.diff(hit) > 1)
            first = hit[new]
            place = hit - np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(hit))))
            hit = hit[place % 2 == 0]
            tokens[hit] = low
            tokens = np.delete(tokens, hit + 1)
            at = hit - np.arange(len(hit))
            rank = np.delete(rank, hit)
            # the pairs beside what was merged
            beside = np.unique(np.concatenate([at - 1, at]))
            beside = beside[(beside >= 0) & (beside < len(rank))]
            fresh = self._pair_ranks(tokens[beside], tokens[beside + 1]) if len(beside) else np.zeros(0, np.int64)
            if len(fresh) and fresh.min() < low:
                return self._by_heap(data)
            rank[beside] = fresh
        return tuple(tokens.tolist())

    def _by_heap(self, data: bytes) -> tuple[int, ...]:
        """``leaf`` with a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, data[i : i + 2]) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            # stale where either part has changed since
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != len(whole) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(whole + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, whole + parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + whole)) is not None:
                heapq.heappush(heap, (r, h, parts[h] + whole))
        return tuple(ranks[p] for p in parts if p is not None)

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens' bytes together encode to just these two tokens."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[key] = self.leaf(self.vocab[a] + self.vocab[b]) == key
        return known

    def join(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of ``x`` followed by those of ``y``, both encodings themselves."""
        if not x or not y:
            return x or y
        if self.stable(x[-1], y[0]):
            return x + y
        left, right, vocab = 1, 1, self.vocab
        while True:
            window = b"".join(vocab[t] for t in x[-left:]) + b"".join(vocab[t] for t in y[:right])
            middle = self.leaf(window)
            grow_left = left < len(x) and not self.stable(x[-left - 1], middle[0])
            grow_right = right < len(y) and not self.stable(middle[-1], y[right])
            if not grow_left and not grow_right:
                return x[:-left] + middle + y[right:]
            # doubling keeps long joins linear in what changes
            left = min(len(x), left * 2) if grow_left else left
            right = min(len(y), right * 2) if grow_right else right

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Token ids of one pattern match."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        known = self.memo.get(data)
        if known is not None:
            return known
        return self._node(data, self.memo) if len(data) <= 16 else self._long(data)

    def _node(self, data: bytes, memo: dict[bytes, tuple[int, ...]]) -> tuple[int, ...]:
        n = len(data)
        half = n // 2
        out = self.leaf(data) if n <= LEAF else self.join(self.encode(data[:half]), self.encode(data[half:]))
        if len(memo) > CACHE_ENTRIES:
            memo.clear()
        memo[data] = out
        return out

    def _long(self, data: bytes) -> tuple[int, ...]:
        """The tree over a long match; equal nodes, as runs and periods have, are encoded once while their bytes fit the bound."""
        seen: dict[bytes, tuple[int, ...]] = {}
        held = 0

        def node(part: bytes) -> tuple[int, ...]:
            nonlocal held
            if len(part) <= 16:
                return self.encode(part)
            out = seen.get(part)
            if out is None:
                half = len(part) // 2
                out = self.join(node(part[:half]), node(part[half:]))
                held += len(part)
                if held > REMEMBERED:
                    seen.clear()
                    held = len(part)
                seen[part] = out
            return out

        return node(data)

    def decode(self, ids: list[int] | tuple[int, ...] | memoryview) -> bytes:
        """Bytes of a token sequence, up the tree: blocks of tokens, then neighbours, level by level."""
        vocab = self.vocab.__getitem__
        level = [b"".join(map(vocab, ids[k : k + BLOCK])) for k in range(0, len(ids), BLOCK)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=2)
def load(path: str) -> MonoidBPE:
    """The encoder of a rank file: a line has a token's bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return MonoidBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Packed(dict):
    """Pattern match to its ids as little-endian unsigned 32-bit bytes; misses are encoded, kept up to a bound."""

    def __init__(self, bpe: MonoidBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = self.bpe.encode(word.encode("utf-8"))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) > CACHE_ENTRIES:
                self.clear()
            self[word] = out
        return out


_WORKER: dict[str, Packed] = {}


CLEAR["bpe"] = [_WORKER.clear, load.cache_clear]


@task("bpe")
def _encode(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    packed = _WORKER.setdefault(path, Packed(bpe)).__getitem__
    find, find_plain = regex.compile(PATTERN).findall, re.compile(PLAIN_PATTERN).findall
    for batch in batches:
        counts, hashes, decoded, ids = [], [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            raw = b"".join(map(packed, (find_plain if plain(text) else find)(text)))
            tokens = memoryview(raw).cast("I")
            counts.append(len(tokens))
            hashes.append(hashlib.sha256(raw).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(tokens)).hexdigest())
            if keep:
                ids.append(tokens.tolist())
        cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep:
            cols, names = [*cols, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
        yield pa.record_batch(cols, names=names)


def encode_texts(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (``keep_ids``) ids of every whole text.

    A null or empty text has no tokens; ids of documents may repeat or be null; an empty table gives no rows;
    other columns are ignored. Narrow: no shuffle. A pattern match of any length is encoded in a tree of depth
    log n; caches are bounded.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids
    return id_text(df, id_col, text_col).mapInArrow(lambda it: _encode(it, ranks_path, keep_ids), schema)


def decode_ids(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes of each id list; a null list gives empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([bpe.decode(x.as_py() or ()) for x in batch.column(1)], pa.binary())], names=["doc_id", "decoded"])

    return df.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids").mapInArrow(run, "doc_id long, decoded binary")
