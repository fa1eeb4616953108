"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of frequent pre-tokens, of fixed size: sorted hashes and lengths.
Tier two is a cache in each Python worker; what neither holds is encoded there and then. No pre-token is ever
shuffled: which are frequent is counted over all texts in sketches of bounded size, one a task, and those are merged.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pagemill.llm.common import CLEAR, id_text, runs, task

# The pre-token pattern of byte-level BPE, with Unicode's White_Space written out.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: The same for texts of code points up to PLAIN, in the faster standard library: there letters and numbers are what \w
#: matches but the underscore, and numbers are the decimal digits and the fixed few that follow.
NUMBERS = r"\d²³¹¼½¾"
PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W_{NUMBERS}]+| ?[{NUMBERS}]+| ?(?:[^\w{SPACE}]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Pre-tokens of the table and of a sketch, at most; sketches that the driver merges.
TABLE_SIZE, SKETCH, MERGED = 32_768, 16_384, 64
CACHE_ENTRIES = 400_000
#: Code points past these may be classed otherwise by another Unicode version: such texts are split by the library's own rules.
PLAIN = "ɏ"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter by which byte-level BPE writes each byte: printable Latin-1 as itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def spelled(word: str, letters: dict[int, str]) -> str:
    """A word in byte letters; ASCII without blanks is its own spelling."""
    if word.isascii() and word.isalnum():
        return word
    return word.encode("utf-8").decode("latin-1").translate(letters)


def unspelled(piece: str) -> str:
    """The text of a piece in byte letters; bytes of a character that the library cut in two stay as they are."""
    return bytes(_letter_bytes()[c] for c in piece).decode("utf-8", "surrogateescape")


@lru_cache(maxsize=1)
def _letter_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


class Table:
    """Lengths of frequent pre-tokens: 128-bit hashes, sorted by their upper halves, and the lengths beside them."""

    def __init__(self, lengths: dict[str, int]):
        rows = sorted((*divmod(xxhash.xxh3_128_intdigest(w.encode("utf-8", "surrogateescape")), 1 << 64), n) for w, n in lengths.items())
        self.high, self.low = (np.array([r[k] for r in rows], np.uint64) for k in (0, 1))
        self.length = np.array([r[2] for r in rows], np.uint16)

    def get(self, word: str) -> int | None:
        high, low = divmod(xxhash.xxh3_128_intdigest(word.encode("utf-8", "surrogateescape")), 1 << 64)
        at = int(np.searchsorted(self.high, np.uint64(high)))
        return int(self.length[at]) if at < len(self.high) and self.high[at] == high and self.low[at] == low else None


class Lengths(dict):
    """Pre-token to number of tokens: the table first, then this cache, kept up to a bound; what neither has is encoded."""

    def __init__(self, table: Table, path: str):
        super().__init__()
        self.table, self.model = table, _tokenizer(path).model
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, word: str) -> int:
        n = self.table.get(word)
        if n is None:
            n = len(self.model.tokenize(spelled(word, self.letters)))
        if len(word) <= 64:
            if len(self) > CACHE_ENTRIES:
                self.clear()
            self[word] = n
        return n


def plain(text: str) -> bool:
    """Whether all code points are up to PLAIN."""
    return text.isascii() or max(text) <= PLAIN


class Splitter:
    """Pre-tokens of any text, as the tokenizer has them: its special strings part the text, patterns split what is plain, the
    library's own pre-tokeniser the rest."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or r"(?!)")
        self.find = re.compile(PLAIN_PATTERN).findall

    def parts(self, text: str) -> list[str]:
        """The texts between special strings."""
        return self.cut.split(text) if any(s in text for s in self.specials) else [text]

    def words(self, part: str) -> list[str]:
        if not part or plain(part):
            return self.find(part)
        return [unspelled(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]


_WORKER: dict[str, tuple[Splitter, Lengths]] = {}


CLEAR["tokencount"] = [_WORKER.clear, _tokenizer.cache_clear]


@task("tokencount")
def count_batches(batches: Iterator[pa.RecordBatch], path: str, table: Table, limit: int) -> Iterator[pa.RecordBatch]:
    if path not in _WORKER:
        _WORKER[path] = Splitter(path), Lengths(table, path)
    split, cache = _WORKER[path]
    lengths = cache.__getitem__
    for batch in batches:
        sizes, counts = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            sizes.append(len(text) if text.isascii() else len(text.encode("utf-8")))
            parts = split.parts(text)
            counts.append(len(parts) - 1 + sum(sum(map(lengths, split.words(p))) for p in parts))
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


class Sketch:
    """The most frequent words of a stream in bounded memory, by lossy counting: when full the rarest half goes."""

    def __init__(self, size: int = SKETCH):
        self.counts: Counter[str] = Counter()
        self.size = size

    def add(self, words: list[str] | dict[str, int]) -> None:
        self.counts.update(words)
        if len(self.counts) > 8 * self.size:
            self.counts = Counter(dict(self.top(4 * self.size)))

    def top(self, n: int) -> list[tuple[str, int]]:
        return heapq.nsmallest(n, self.counts.items(), key=lambda x: (-x[1], x[0]))

    def packed(self) -> bytes:
        kept = [(w, n) for w, n in self.top(self.size) if len(w) <= 64]
        return zlib.compress(json.dumps(kept).encode("ascii"))

    def merge(self, packed: bytes) -> None:
        self.add(dict(map(tuple, json.loads(zlib.decompress(packed)))))


@task("tokencount")
def _sketch(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    split, sketch = Splitter(path), Sketch()
    for batch in batches:
        for value in batch.column(0):
            for part in split.parts(value.as_py() or ""):
                sketch.add(split.words(part))
    yield pa.record_batch([pa.array([TaskContext.get().partitionId() % MERGED], pa.int32()), pa.array([sketch.packed()], pa.binary())], names=["lot", "packed"])


@task("tokencount")
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, 1):
        sketch = Sketch()
        for packed in group.column(1):
            sketch.merge(packed.as_py())
        yield pa.record_batch([group.column(0).slice(0, 1).combine_chunks(), pa.array([sketch.packed()], pa.binary())], names=["lot", "packed"])


def frequent_lengths(docs: DataFrame, path: str, size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the ``size`` most frequent pre-tokens of all texts, as far as bounded sketches tell.

    A sketch has at most SKETCH words of at most 64 characters, and at most MERGED sketches reach the driver,
    whatever the corpus. The table only saves work: any table, an empty one too, gives the same counts.
    """
    kind = "lot int, packed binary"
    lots = docs.select("text").mapInArrow(lambda it: _sketch(it, path), kind).repartition(MERGED, "lot").sortWithinPartitions("lot").mapInArrow(_merge, kind)
    total = Sketch(size)
    for row in lots.select("packed").collect():
        total.merge(bytes(row.packed))
    lengths = Lengths(Table({}), path)
    return {w: lengths[w] for w, _ in total.top(size)}


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every whole text.

    A null or empty text has 0 bytes and 0 tokens; ids may repeat or be null, each row counts for itself; an
    empty table gives no rows; other columns are ignored. A special string is one token; a text of any length is
    split whole, and a pre-token of over 64 characters is encoded each time. Narrow: no shuffle of texts or
    pre-tokens; a worker's cache is bounded.
    """
    docs = id_text(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(Table(frequent_lengths(docs, tokenizer_path)))
    return docs.mapInArrow(lambda it: count_batches(it, tokenizer_path, shared.value, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
