"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.llm import byte_bpe, embedding_join, hard_negatives, language_id, line_dedup, packing, quality, simhash, substring_index, token_cache, toxicity, vector_codes, vector_search
from boxlens.llm.common import crc32_of_id, table

WORD_TOKENIZER, BYTE_TOKENIZER, MULTI_RANKS = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"
TOKEN_LIMIT = 2048


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.pmod(crc32_of_id(), F.lit(4)) == 2, F.lit(False)))
    net = language_id.fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), net, keep_text=False)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two batches through one cache: the second finds what the first one stored."""
    cache, docs = token_cache.fresh_cache(spark, _path(WORD_TOKENIZER)), table(spark, sf_dir, "documents")
    early = F.coalesce(F.pmod(crc32_of_id(), F.lit(2)) == 0, F.lit(True))
    counted = cache.count(docs.where(early)).unionByName(cache.count(docs.where(~early)))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc32_of_id(), F.lit(3)) == 1, F.lit(False))
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.scored(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _path(BYTE_TOKENIZER))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), _path(MULTI_RANKS), public_tokenizers.PATTERN)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_index.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc32_of_id(), F.lit(4)) == 2, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_line_dedup": op2_line_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_toxicity": op4_toxicity,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_vector_codes": op12_vector_codes,
        "op13_quality": op13_quality,
    }


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(least(e.vec_id, coalesce(m, e.vec_id)) AS BIGINT) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least ON e.vec_id = least.a LEFT JOIN counted ON e.vec_id = counted.a
"""

OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN repeated USING (s)),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p
  GROUP BY x.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


OP11_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND (a.vec_id <> b.vec_id OR a.label <> b.label) AND len(a.e) = len(b.e)
),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN scores s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


def _op12_sql(rounds: int = 6) -> str:
    """A table of assignments and one of entries a round, components in long form. Of 64 components, eight a part."""
    parts = ["""k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, * FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
    """x AS MATERIALIZED (SELECT r, (i - 1) // 8 AS part, (i - 1) % 8 AS pos, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS c FROM k, unnest(range(1, 65)) AS t(i))""",
    "b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, c FROM x WHERE r <= 16)"]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, part, entry, d FROM (
  SELECT x.r, x.part, b.entry, CAST(sum((x.c - b.c) * (x.c - b.c)) AS BIGINT) AS d FROM x JOIN b{n} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)""")
        if n < rounds:
            parts.append(f"""b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN (
  SELECT part, entry, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS c FROM (SELECT x.part, a.entry, x.pos, CAST(sum(x.c) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{n} a ON x.r = a.r AND x.part = a.part GROUP BY ALL)
  ) m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)""")
    return f"""WITH {", ".join(parts)},
f AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(c, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM k JOIN f USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """The others apply trained models, tokenizers or XXH64; tests hold them against brute force."""
    return {"op5_embedding_near_dedup": OP5_SQL, "op10_substring_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_vector_codes": _op12_sql()}
