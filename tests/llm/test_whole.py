"""Whole jobs where an earlier state did less: crowds of vectors, shared ids."""

import numpy as np
import pytest

from pagemill.llm import jaccard, vectors


def crowd(n, crowded, pairs, cosine=0.9, linked=0.952, d=64):
    """Unit vectors, a part of them at ``cosine`` to each other, ``pairs`` of those planted at ``linked``."""
    rng = np.random.default_rng(9)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    middle = unit(rng.normal(size=d))
    x = rng.normal(size=(n, d))
    x[:crowded] = middle * cosine**0.5 + unit(rng.normal(size=(crowded, d))) * (1 - cosine) ** 0.5
    x = unit(x)
    for k in range(pairs):
        other = rng.normal(size=d)
        other = unit(other - (other @ x[k]) * x[k])
        x[crowded - 1 - k] = x[k] * linked + other * (1 - linked**2) ** 0.5
    return x


@pytest.mark.parametrize("rows", [100_000, 1000])
def test_links_in_a_crowd_of_vectors(spark, monkeypatch, rows):
    monkeypatch.setattr(vectors, "ROWS", rows)
    x = crowd(6000, 2000, 200)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_vectors(df, window=8).collect()}
    near = x @ x.T >= 0.95
    missed = 0
    for k in np.flatnonzero(near.sum(axis=1) == 2).tolist():  # pairs on their own
        a, b = np.flatnonzero(near[k]).tolist()
        missed += near[a].sum() == 2 and near[b].sum() == 2 and (got[k].n_links, got[k].component_id) != (1, a)
    assert missed <= 2 and (near.sum(axis=1) == 2).sum() >= 300


def test_rows_that_share_an_id_stay(spark):
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 10**6, 60))
    alone = [(None if k % 3 else 7, text()) for k in range(12)]
    base = [text() for _ in range(6)]
    near = [(None, f"{t} end{k}") for t in base for k in range(2)]  # linked in twos, all without an id
    docs = spark.createDataFrame([*alone, *near, (None, ""), (8, "")], "doc_id long, text string")
    kept = [tuple(r) for r in jaccard.one_of_each(docs).collect()]
    assert set(alone) <= set(kept) and {(None, ""), (8, "")} <= set(kept)
    assert sorted(t.rsplit(" ", 1)[0] for i, t in kept if (i, t) in near) == sorted(base)
    assert len(kept) == len(alone) + len(base) + 2
