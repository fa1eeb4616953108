"""The queries opN_<name>: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, extract, jaccard, language, media, packing, suffixarray, suffixtree, tokencount, vectors
from pagemill.llm.common import small_batches, table


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a 200-byte string starting elsewhere covers, removed; null texts are empty, short ones stay
    whole, equal rows lose what they share."""
    small_batches(spark)
    return suffixarray.dedup_bytes(table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit sound in Matroska and read back; null texts are empty, equal texts give equal values."""
    small_batches(spark)
    return media.store_text(table(spark, sf_dir, "documents", "doc_id", "text"), keep_media=False)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text by a network trained outside the held-out fold; ``und`` where there are no letters."""
    small_batches(spark)
    return language.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document by three-word shingles at 0.9; texts without words link with nothing."""
    small_batches(spark)
    return jaccard.jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text; null texts have none, special strings are one token each."""
    small_batches(spark)
    return tokencount.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95; null, zero and broken vectors link with nothing."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every document's pieces in sequences of 2048 tokens; a null text is the end id alone."""
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null html gives the empty text."""
    small_batches(spark)
    return extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text as digests; null texts have none."""
    small_batches(spark)
    return bpe.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a 13-word window of a smaller id covers, removed; null texts have none."""
    small_batches(spark)
    return suffixtree.dedup_words(table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_media": op2_media,
    "op3_language": op3_language,
    "op4_jaccard": op4_jaccard,
    "op5_token_counts": op5_token_counts,
    "op6_near_vectors": op6_near_vectors,
    "op7_packing": op7_packing,
    "op8_main_text": op8_main_text,
    "op9_bpe": op9_bpe,
    "op10_suffix_tree": op10_suffix_tree,
}

# ---------------------------------------------------------------- the same in DuckDB, where SQL can say it

_WORDS = "regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Bytes as pairs of hexadecimal digits; a window starts a new span if it doesn't touch the one before.
_SQL_1 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d)),
hit AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit),
span AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
edge AS (SELECT doc_id, e AS a FROM span UNION ALL SELECT doc_id, 0 FROM d),
gap AS (SELECT edge.doc_id, a, coalesce((SELECT min(s) FROM span WHERE span.doc_id = edge.doc_id AND s >= a), length(h) // 2) AS b FROM edge JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(e - s) AS r, count(*) AS n FROM span GROUP BY doc_id) x ON d.doc_id = x.doc_id"""

_SQL_4 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(t=_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM pair JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * n >= 90 * (len(a.s) + len(b.s) - n)),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) ON u = doc_id"""

_SQL_6 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) r ON r.u = vec_id LEFT JOIN (SELECT u, count(*) AS n FROM link GROUP BY u) l ON l.u = vec_id"""

_SQL_10 = f"""WITH d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x JOIN f USING (k) WHERE first < doc_id),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array": _SQL_1,
    "op4_jaccard": _SQL_4,
    "op6_near_vectors": _SQL_6,
    "op10_suffix_tree": _SQL_10,
}
