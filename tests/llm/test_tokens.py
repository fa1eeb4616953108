"""Tokenising operators against the public libraries, and packing against its own invariants."""

import array
import bisect
import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import bpe, packing, tokencount

RANKS, BYTE_BPE, WORD_BPE = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load(RANKS).ranks, special_tokens={})


@given(st.text(max_size=80) | st.binary(max_size=60).map(lambda b: b.decode("latin-1")))
@settings(max_examples=300, deadline=None)
def test_monoid_encoding_is_the_library_s(text):
    own = bpe.load(RANKS)
    find = bpe.regex.compile(bpe.PATTERN).findall
    ids = [i for w in find(text) for i in own.encode(w.encode())]
    assert ids == LIBRARY.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@given(st.binary(min_size=1, max_size=40), st.binary(min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_joining_is_encoding_the_whole(a, b):
    own = bpe.load(RANKS)
    assert own.join(own.leaf(a), own.leaf(b)) == own.leaf(a + b)


@pytest.mark.parametrize("unit", [b"a", b"ab", b"=-", b" ", "é".encode(), b"abcabd"])
@pytest.mark.parametrize("n", [63, 65, 1001, 40_015])
def test_runs_and_periods_are_encoded_as_by_the_library(unit, n):
    own, data = bpe.load(RANKS), (unit * n)[:n]
    want = LIBRARY._core_bpe.encode_single_piece(data)
    assert list(own.encode(data)) == want and list(own._by_heap(data)) == want and list(own._by_rank(data)) == want
    assert own.decode(want) == data


def test_a_long_run_takes_about_linear_time():
    own, data = bpe.load(RANKS), b"a" * 1_000_003
    began = time.process_time()
    ids = own.encode(data)
    assert time.process_time() - began < 5 and own.decode(ids) == data
    text = data.decode()
    assert len(ids) == len(Tokenizer.from_file(BYTE_BPE).encode(text).ids)


@given(st.binary(min_size=65, max_size=400) | st.text("ab", min_size=65, max_size=300).map(str.encode))
@settings(max_examples=100, deadline=None)
def test_long_leaves_merge_alike(data):
    own = bpe.load(RANKS)
    want = LIBRARY._core_bpe.encode_single_piece(data)
    assert list(own._by_heap(data)) == want and list(own._by_rank(data)) == want


@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "“so”", " Привет", "日本", " ", "İ", "Σας", "a"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_all_scripts_and_special_strings_are_counted_as_by_the_library(text):
    split, lengths = tokencount.Splitter(BYTE_BPE), tokencount.Lengths(tokencount.Table({" the": 1}), BYTE_BPE)
    parts = split.parts(text)
    assert len(parts) - 1 + sum(lengths[w] for p in parts for w in split.words(p)) == len(Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids)
    assert packing.token_bytes(text, WORD_BPE) == np.array(Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_the_table_is_consulted_before_encoding(docs):
    found = tokencount.frequent_lengths(docs, BYTE_BPE)
    assert len(found) > 100 and found[" be"] == 1
    table = tokencount.Table({" be": 7})
    assert tokencount.Lengths(table, BYTE_BPE)[" be"] == 7 and table.get(" bee") is None


def test_sketches_are_bounded_and_keep_what_is_frequent():
    sketch = tokencount.Sketch(50)
    for k in range(3000):
        sketch.add([f"w{k}", f"x{k}", "often"])
    assert len(sketch.counts) <= 402 and sketch.top(1)[0][0] == "often"


def test_bpe_column(docs, rows):
    got = Counter(tuple(r) for r in bpe.encode_texts(docs, RANKS, keep_ids=False).collect())
    want = Counter()
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want


def test_ids_decode(docs):
    back = bpe.decode_ids(bpe.encode_texts(docs, RANKS), RANKS)
    assert Counter(bytes(r.decoded) for r in back.collect()) == Counter((r.text or "").encode() for r in docs.select("text").collect())


def test_token_counts(docs, rows):
    library = Tokenizer.from_file(BYTE_BPE)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
    assert Counter(tuple(r) for r in tokencount.token_counts(docs, BYTE_BPE).collect()) == want


def test_word_ids_are_the_library_s(rows):
    library = Tokenizer.from_file(WORD_BPE)
    for _, t in rows:
        assert packing.token_bytes(t or "", WORD_BPE) == np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
@settings(max_examples=500, deadline=None)
def test_plain_patterns_match_alike(text):
    assert bpe.re.findall(bpe.PLAIN_PATTERN, text) == bpe.regex.findall(P.PATTERN.replace(r"\s", f"[{tokencount.SPACE}]").replace(r"[^[", "[^").replace(r"]\p{L}\p{N}]", r"\p{L}\p{N}]").replace(r"\S", f"[^{tokencount.SPACE}]"), text)
    library = Tokenizer.from_file(WORD_BPE)
    assert packing.token_bytes(text, WORD_BPE) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_plain_code_point_is_classed_as_by_unicode():
    for c in map(chr, range(0x250)):
        assert bool(bpe.re.fullmatch(rf"[^\W_{tokencount.NUMBERS}]", c)) == bool(bpe.regex.fullmatch(r"\p{L}", c)), c
        assert bool(bpe.re.fullmatch(rf"[{tokencount.NUMBERS}]", c)) == bool(bpe.regex.fullmatch(r"\p{N}", c)), c


def check_packed(pieces, texts, capacity):
    library = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            want[i, k // capacity, k, len(own), zlib.crc32(array.array("I", own).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, rows, capacity):
    pieces = packing.pack(docs, WORD_BPE, capacity=capacity).collect()
    n = check_packed(pieces, rows, capacity)
    assert n <= 1.1 * -(-sum(r.length for r in pieces) // capacity) + 1


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_plan_places_everything(histogram):
    plan = packing.plan(histogram, capacity=64, bins=32)
    placed = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 64 and n > 0
        for x in lengths:
            placed[x] += n
    assert placed == Counter(histogram)
    assert sum(n for _, n in plan) <= 1.35 * best_fit(histogram, 64) + 2


def best_fit(histogram, capacity):
    gaps, used = [], 0
    for x in sorted(Counter(histogram).elements(), reverse=True):
        at = bisect.bisect_left(gaps, x)
        if at == len(gaps):
            used += 1
            gap = capacity
        else:
            gap = gaps.pop(at)
        bisect.insort(gaps, gap - x)
    return used


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_about_as_good_as_best_fit_on_document_lengths(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6.2, 1.1, 8000).astype(int), 1, 2048)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    assert sum(n for _, n in packing.plan(histogram)) <= 1.005 * best_fit(histogram, 2048) + 1


@pytest.mark.parametrize(("mean", "spread"), [(6.3, 1.0), (4.8, 0.7), (3.9, 0.6), (5.6, 0.8), (5.0, 1.5)])
def test_patterns_place_nearly_all_pieces(mean, spread):
    lengths = np.maximum(1, np.random.default_rng(1).lognormal(mean, spread, 8000).astype(int))
    histogram = Counter(x for n in lengths.tolist() for x in [2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0))
    told = {}
    plan = packing.plan(dict(histogram), told=told)
    assert told["by_patterns"] >= 0.9 * sum(histogram.values())
    assert sum(n for _, n in plan) <= 1.002 * best_fit(histogram, 2048) + 1


def test_places_are_runs_of_ordinals():
    length, first, sequence, offset = packing.places([((3, 2), 4), ((3, 3), 2)])
    assert list(zip(length.tolist(), first.tolist(), sequence.tolist(), offset.tolist(), strict=True)) == [(2, 0, 0, 3), (3, 0, 0, 0), (3, 4, 4, 0), (3, 6, 4, 3)]


def test_nnls_solves_and_stays_non_negative():
    rng = np.random.default_rng(0)
    a = rng.random((12, 30))
    x = np.maximum(rng.normal(size=30), 0)
    got = packing.nnls(a, a @ x)
    assert got.min() >= 0 and np.allclose(a @ got, a @ x, atol=1e-6)


@pytest.mark.parametrize("run", [lambda d: bpe.encode_texts(d, RANKS), lambda d: tokencount.token_counts(d, BYTE_BPE), lambda d: packing.pack(d, WORD_BPE)])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0
