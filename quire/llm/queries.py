"""Registered queries of the corpus operators, and SQL for those that SQL can express.

Each query applies its operator, with production parameters, to its whole
table and derives the digest columns from the operator's outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import conversations, decontaminate, jaccard, knn, langid, lexical, lm, packing, pii, quality, simhash, token_counts, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_crc() % 5 == 0, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    return langid.predict(docs, langid.train(docs.where(~F.col("held_out"))), keep=("doc_id", "held_out"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.topk(table(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file (installed with the package that describes them)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_crc() % 7 == 2, F.lit(True))
    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), size=2048, end_id=0)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_crc() % 5 == 0, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return quality.quality(docs, table(spark, sf_dir, "labels")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base_spans"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), n=4, most=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontamination": op2_decontamination,
    "op3_exact_topk": op3_exact_topk,
    "op4_token_counts": op4_token_counts,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_url_filter": op10_url_filter,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op3_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets), cells AS (SELECT doc_id, unnest(s) AS t FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM cells a JOIN cells b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM sizes
""",
    "op11_prefix_trie": """
WITH t AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, s) AS p, s, bytes FROM (
    SELECT conv_id AS c, turn, sha256(length(role) || ':' || role || text) AS s, strlen(text) AS bytes
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
), c AS (
  SELECT c, count(*) AS n, c - c % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, x: list_reduce(list_prepend(xor(s, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
  FROM t GROUP BY c
), r AS (
  SELECT c.c, t.p AS d, s, bytes FROM c JOIN t ON t.c = c.base AND t.p <= c.h
  UNION ALL SELECT c.c, t.p - c.h + least(c.h, coalesce(b.n, 0)), s, bytes FROM c JOIN t ON t.c = c.c AND t.p > c.h LEFT JOIN c b ON b.c = c.base
), m AS (SELECT c, d, bytes, string_agg(s, ',') OVER (PARTITION BY c ORDER BY d) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM c),
n AS (SELECT d, k, min(c) AS v, count(*) AS convs, any_value(bytes) AS bytes FROM m GROUP BY d, k),
up AS (SELECT n.v, n.d, p.v AS parent FROM n JOIN m ON m.c = n.v AND m.d = n.d - 1 JOIN n p ON p.d = m.d AND p.k = m.k),
kids AS (SELECT parent AS v, d - 1 AS d, count(*) AS kids FROM up GROUP BY ALL),
below AS (
  SELECT a.v, a.d, sum(CASE WHEN kids.kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.convs - 1) * u.bytes) AS saved
  FROM n u LEFT JOIN kids ON kids.v = u.v AND kids.d = u.d JOIN m ON m.c = u.v AND m.d <= u.d JOIN n a ON a.d = m.d AND a.k = m.k GROUP BY a.v, a.d
), ends AS (
  SELECT n.v, n.d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ids
  FROM (SELECT c, max(d) AS d FROM m GROUP BY c) JOIN m USING (c, d) JOIN n USING (d, k) GROUP BY n.v, n.d
)
SELECT n.v AS conv_id, CAST(n.d AS BIGINT) AS depth, parent AS parent_conv_id, convs AS n_convs, coalesce(kids, 0) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ids, sha256('')) AS ends_sha256
FROM n LEFT JOIN up USING (v, d) LEFT JOIN kids USING (v, d) JOIN below USING (v, d) LEFT JOIN ends USING (v, d)
""",
    "op12_ranked_search": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS w FROM documents
), held AS (SELECT r, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
corpus AS (SELECT count(*) AS docs, sum(n) AS terms FROM held),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM held) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
q AS (
  SELECT i, item_id, t, count(*) AS times FROM (
    SELECT i, item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS t
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)) GROUP BY ALL
), s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN p USING (t) CROSS JOIN corpus GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
""",
}
