"""Deduplication operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F

from pagemill.llm import anchors, jaccard, suffixarray, suffixtree, vectors
from pagemill.llm.common import components


def removed_bytes(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
        out[i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "rivals"), [(200, 1024), (40, 1024), (40, 1)])
def test_bytes(docs, rows, length, rivals, monkeypatch):
    monkeypatch.setattr(suffixarray, "RIVALS", rivals)
    got = Counter(tuple(r) for r in suffixarray.dedup_bytes(docs, length=length, keep_text=False).collect())
    assert got == removed_bytes(rows, length)


def test_kept_texts_and_whole_rows(docs):
    kept = suffixarray.without_repeats(docs, length=40)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    texts = {r.doc_id: r.text for r in suffixarray.dedup_bytes(docs, length=40).collect()}
    assert {r.doc_id: r.text for r in kept.collect()} == texts


def test_suffix_arrays_of_many_strings_at_once():
    rng = random.Random(1)
    for _ in range(300):
        strings = []
        for _ in range(rng.randint(1, 5)):
            s = [rng.randint(0, rng.choice((1, 2, 4))) for _ in range(rng.randint(0, 40))]
            strings.append((s[: rng.randint(1, 4)] * 20)[: len(s)] if s and rng.random() < 0.3 else s)
        bounds = np.cumsum([0, *map(len, strings)])
        want = [int(bounds[k]) + i for k, s in enumerate(strings) for i in sorted(range(len(s)), key=lambda i: s[i:])]
        assert suffixarray.build(np.array([c for s in strings for c in s], np.int64), bounds).tolist() == want


def removed_words(rows, size):
    key = lambda i: anchors.NO_ID if i is None else i
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - size + 1):
            s = tuple(w[k : k + size])
            first[s] = min(first.get(s, key(i)), key(i))
    out = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < key(i):
                gone[k : k + size] = [True] * size
        out[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("rivals", [2048, 2, 1])
def test_words(docs, rows, rivals, monkeypatch):
    monkeypatch.setattr(suffixtree, "RIVALS", rivals)
    assert Counter(tuple(r) for r in suffixtree.dedup_words(docs, keep_text=False).collect()) == removed_words(rows, 13)


@pytest.fixture(scope="module")
def shared_ids(spark):
    """Hundreds of rows without an id or with one of two ids, all of different texts, half of them with passages of others."""
    rng = random.Random(12)
    passages = [" ".join(f"p{k}w{rng.randrange(5000)}" for _ in range(40)) for k in range(5)]
    rows = []
    for k in range(600):
        own = " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))
        rows.append(((None, None, 7, 8)[k % 4], own if k % 2 else f"{own} {passages[k % 5]} x{k}"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


def test_rows_that_share_ids_keep_what_is_theirs(shared_ids):
    rows, df = shared_ids
    assert Counter(tuple(r) for r in suffixarray.dedup_bytes(df, keep_text=False).collect()) == removed_bytes(rows, 200)
    assert Counter(tuple(r) for r in suffixtree.dedup_words(df, keep_text=False).collect()) == removed_words(rows, 13)
    kept = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in suffixarray.without_repeats(df).collect())
    assert kept == Counter((i, h) for (i, _, _, _, h), n in removed_bytes(rows, 200).items() for _ in range(n))


def test_names_need_both_halves_of_a_text_s_hash(shared_ids, monkeypatch):
    rows, df = shared_ids
    whole = anchors.tags
    for half in (0, 1):
        monkeypatch.setattr(anchors, "tags", lambda text, half=half: [F.lit(0).cast("long").alias(c) if k == half else x for k, (c, x) in enumerate(zip(("t1", "t2"), whole(text), strict=True))])
        assert Counter(tuple(r) for r in suffixarray.dedup_bytes(df, keep_text=False).collect()) == removed_bytes(rows, 200)


@pytest.mark.parametrize(("memory", "read"), [(40_000, 400_000), (3, 1), (50, 64)])
def test_subtrees_find_what_a_dictionary_finds(memory, read, monkeypatch):
    monkeypatch.setattr(suffixtree, "READ", read)
    rng = np.random.default_rng(memory)
    x = rng.integers(0, 3, (400, 5)).astype(np.uint64)
    group, least = rng.integers(0, 4, 400), rng.integers(0, 1000, 400)
    low, many = suffixtree.repeats(x, group, least, memory)
    same = defaultdict(list)
    for k in range(400):
        same[(int(group[k]), *x[k].tolist())].append(k)
    for rows in same.values():
        assert set(low[rows]) == {least[rows].min()} and set(many[rows]) == {len(rows)}


def linked(rows):
    sets = {}
    for i, t in rows:
        w = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()).split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.fixture(scope="module")
def close(corpus):
    """The corpus and families of copies around the threshold, and one large family of near copies."""
    rng = random.Random(8)
    out = list(corpus)
    for family in range(12):
        base = [f"w{family}x{rng.randrange(400)}" for _ in range(rng.choice((4, 40, 120)))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 20))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
            out.append((10_000 + len(out), " ".join(w)))
    base = [f"h{k}" for k in range(200)]
    for k in range(60):
        w = list(base)
        w[rng.randrange(200)] = f"u{k}"
        out.append((10_000 + len(out), " ".join(w)))
    return out


@pytest.mark.parametrize("tile", [1024, 4])
def test_jaccard_components(spark, close, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    df = spark.createDataFrame([*close, (9001, None)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df).collect()}
    assert got == linked([*close, (9001, None)])


def test_jaccard_with_odd_rows(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect() if r.doc_id is not None}
    assert got == linked([r for r in rows if r[0] is not None])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert Counter(ids) == Counter([None, *{c for _, c in got.values()}])


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 30, 900, 9000):
        a, b = (np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: n // 2], b[n // 2 :]]))
        assert jaccard.differing(jaccard.bitmap(a), jaccard.bitmap(b)) <= len(np.setxor1d(a, b))


def test_prefixes_of_linked_sets_meet():
    for n in range(1, 300):
        for m in range(n, min(300, n * 10 // 9) + 1):
            need = -(-9 * (n + m) // 19)
            if need <= n:
                assert (n - jaccard.prefix_size(n)) + 1 <= need and (m - jaccard.prefix_size(m)) + 1 <= need
    assert jaccard.prefix_size(10, Fraction(9, 10)) == 2


@pytest.mark.parametrize("bound", [10**6, 0])
def test_components(spark, bound):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, 500)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5), bound=bound).collect()}
    assert got == {x: find(x) for x in up}


def test_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    x = [*(c + rng.normal(size=16) * s for c in centres for s in (0, 0, 0.05, 0.1, 0.2, 0.25)), *rng.normal(size=(300, 16)), np.full(16, 1e-300), np.full(16, 1e300)]
    good = [(k, [float(v) for v in row], 1) for k, row in enumerate(x)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [None] + [1.0] * 15, 1), (9006, [], 1), (9007, [1.0] * 3, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, component_id int")
    got = {r.vec_id: tuple(r)[1:] for r in vectors.near_vectors(df).collect()}
    y = np.stack(x)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    for k in range(len(x)):
        assert got[k][0] == near[k].sum() - 1
        reach, last = near[k].copy(), None
        while last is None or (reach != last).any():
            last, reach = reach, near[reach].any(axis=0)
        assert got[k][1] == np.flatnonzero(reach)[0] and got[k][2] == (got[k][1] == k)
    for k, *_ in odd:
        assert got[k] == (0, k, True if k is not None else None)


def crowd(kind, n, d=48):
    """Vectors with a common direction or in clusters, and a partner at a cosine of 0.955 for each twentieth."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "direction":
        x = unit(np.sqrt(0.84) * unit(rng.normal(size=(1, d))) + np.sqrt(0.16) * unit(rng.normal(size=(n, d))))
    else:
        x = unit(unit(rng.normal(size=(12, d)))[rng.integers(0, 12, n)] + 0.45 * unit(rng.normal(size=(n, d))))
    k = n // 20
    side = rng.normal(size=(k, d))
    side = unit(side - (side * x[:k]).sum(axis=1, keepdims=True) * x[:k])
    x[n - k :] = 0.955 * x[:k] + np.sqrt(1 - 0.955**2) * side
    return x


@pytest.mark.parametrize("kind", ["direction", "clusters"])
@pytest.mark.parametrize("rows", [400, 100_000])
def test_recall_on_crowded_vectors(spark, kind, rows, monkeypatch):
    """Both ways of a large table (windows for what is sparse) and of a small one, against all pairs."""
    monkeypatch.setattr(vectors, "ROWS", rows)
    x = crowd(kind, 4000)
    near = (x @ x.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    found = np.array([got[k] for k in range(len(x))])
    assert (found <= near).all() and near.sum() >= 400 and found.sum() >= 0.98 * near.sum()


def test_vectors_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=16) + rng.normal(size=(40, 16)) * 0.05
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()} == {(39, 0)}


@pytest.mark.parametrize("run", [suffixarray.dedup_bytes, suffixarray.without_repeats, suffixtree.dedup_words, jaccard.jaccard_join, jaccard.one_of_each])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("run", [suffixarray.without_repeats, suffixarray.dedup_bytes, suffixtree.dedup_words])
def test_buckets_with_nothing_but_markers(spark, monkeypatch, run):
    """A task's last step holds few rows and the many buckets of a large table hardly any: what repeats in the step then
    sends a bucket a marker alone, which has no positions. Two steps a task here, the second of one copied text."""
    rng = random.Random(21)
    long, copied = (" ".join(f"z{rng.randrange(10**6)}" for _ in range(n)) for n in (300, 90))
    rows = [(1, long), (2, copied), (3, copied), (4, long[500:1500] + " end")]
    monkeypatch.setattr(anchors, "FLUSH", 10)
    monkeypatch.setattr(anchors, "STEP", 1500)
    monkeypatch.setattr(anchors, "input_bytes", lambda df: 4_000_000 * 60)
    got = run(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    if run is suffixarray.without_repeats:
        want = Counter((i, h) for i, *_, h in removed_bytes(rows, 200))
        assert Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == want
    elif run is suffixarray.dedup_bytes:
        assert Counter(tuple(r)[:5] for r in got) == removed_bytes(rows, 200)
    else:
        assert Counter(tuple(r)[:4] for r in got) == removed_words(rows, 13)


def test_packed_rows_come_back():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5):
        for most in (0, 3):
            count = rng.integers(0, most + 1, n).astype(np.int32)
            rows = {k: rng.integers(0, 1 << 30, n).astype(t) for k, t in anchors._FIELDS} | {"count": count, "positions": rng.integers(0, 1 << 40, int(count.sum()))}
            back = anchors._unpack(anchors._pack(rows))
            assert back.keys() == rows.keys() and all(back[k].dtype == rows[k].dtype and back[k].tolist() == rows[k].tolist() for k in rows)
