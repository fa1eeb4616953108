"""The pipeline's stages, each on what its predecessor kept."""

import re

import public_tokenizers as P

import __spark_entry__
import corpus_pipeline as C
from pagemill.llm import language, queries, suffixarray
from pagemill.llm.common import drop_tables, materialise


def one_of_each(rows):
    """Smallest ids of the groups that five-word shingles link at 0.8, by comparing all pairs."""
    sets = {}
    for r in rows:
        w = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (r.text or "").encode()).split()
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {find(i) for i in ids}


def test_near_copies_of_a_few_changed_words_go(spark):
    """Six evenly spread changed words of 300: 0.816 by five words, under 0.9 by three."""
    words = [f"w{k}" for k in range(300)]
    changed = [f"c{k}" if k % 50 == 25 else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, "other words of its own")], "doc_id long, text string")
    assert {r.doc_id for r in C.near_copies(spark, docs, "").collect()} == {1, 3}


def test_texts_of_no_language_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    code = "def walk(x):\n    for y in x.items():\n        yield y[0] + 1\nclass Node(object):\n    left = None\n" * 3
    odd = spark.createDataFrame([(-1, code), (-2, "Все люди рождаются свободными и равными в своём достоинстве и правах. " * 3), (-3, "xq zkw vvbn qpw rtzk mnbv qqx zzkj wpqr xcvb lkjh qwpo zmxn " * 4)], "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    assert {r.doc_id for r in C.language_id(spark, both, sf).where("doc_id < 0").collect()} == set()


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in C.STAGES:
        kept.append(materialise(stage(spark, kept[-1], sf), name))
        if name != C.STAGES[-1][0]:
            assert kept[-1].columns == columns
    known, near, cut, packed = kept[1:]
    clean = {r.doc_id for r in docs.collect() if r.text and language.LETTER.search(r.text)}
    assert {r.doc_id for r in known.collect()} == clean
    assert {r.doc_id for r in near.collect()} == one_of_each(known.collect())
    texts = {r.doc_id: r.text for r in suffixarray.dedup_bytes(near).collect()}
    assert {r.doc_id: r.text for r in cut.collect()} == texts and all(r.n_chars == len(r.text) for r in cut.collect())
    assert {r.doc_id for r in packed.collect()} == set(texts)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_run_is_the_stages_in_turn(spark, sf):
    ids = {r.doc_id for r in C.run(spark, sf).select("doc_id").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), "stage")
    assert ids == {r.doc_id for r in docs.collect()}


def test_written_tables_can_be_dropped(spark):
    table = materialise(spark.range(3), "numbers")
    assert table.count() == 3 and drop_tables(spark) > 0
    assert drop_tables(spark) == 0


def test_letterless_documents_go(spark, sf):
    docs = spark.createDataFrame([(1, "12 34", "en", "s", 5), (2, None, "en", "s", 0), (3, "the house and the garden", "en", "s", 24), (4, "la maison et le jardin", "fr", "s", 22)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in C.STAGES[0][1](spark, docs, sf).collect()} <= {3, 4}


def test_eleven_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert P.path("word_bpe_49k.json")
