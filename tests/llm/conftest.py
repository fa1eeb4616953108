import random

import pytest


def words(rng, n, base=3000):
    return [f"{'aeiou'[rng.randrange(5)]}{'bcdfglmnprst'[rng.randrange(12)]}{rng.randrange(base):x}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: plain, near and exact copies, shared passages, periodic and very long texts, odd characters."""
    rng = random.Random(3)
    passage = " ".join(words(rng, 60))
    out = []
    for k in range(40):
        w = words(rng, rng.choice((3, 20, 80, 200)))
        out.append(" ".join(w))
        if k % 5 == 0:
            near = list(w)
            near[len(near) // 2] = "changed"
            out.append(" ".join(near))
        if k % 7 == 0:
            out.append(" ".join(w))
        if k % 4 == 0:
            out.append(" ".join(words(rng, 15)) + " " + passage + "\n" + " ".join(words(rng, 15)))
    out += ["be " * 400, "be " * 380 + "x", "ab" * 700, "ab" * 600, passage + "\t\x0b" + passage, "", "one", "One two", "one TWO", "   \n ", "é" * 300 + " naïve", "日本語のテキスト 𝒳𝒴 z", "a<|endoftext|>b <|startoftext|>", "x" * 5000, " ".join(words(rng, 30000)), "\x00\x1c weird \x85\xa0 spaces here", "12 345 !?... it's we'll"]
    return [(k * 3 + 1, t) for k, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with a null text, a null id and a repeated row, and columns whose names operators use themselves."""
    rows = [*corpus, (9001, None), (None, "no id here at all"), corpus[0]]
    full = [(i, t, "en", 5, "x", 7, "y", [1]) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, n_bytes int, id string, tag int, row string, spans array<int>").repartition(5)


@pytest.fixture(scope="session")
def rows(corpus):
    return [*corpus, (9001, None), (None, "no id here at all"), corpus[0]]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
