"""The registered queries of this subpackage, one for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach
from .decontaminate import benchmark_hits, contaminated
from .hard_negatives import hard_negatives
from .html_extract import extract_main_text
from .importance import resample
from .langid import fit, identify
from .line_dedup import line_verdicts
from .mixing import in_training_order, mixture
from .near_dup import near_duplicates
from .quality_classifier import fit_quality, grade_documents
from .quality_rules import quality_verdicts
from .rules_sql import quality_rules_sql
from .secrets import scan_secrets
from .token_shards import read_shards, write_shards
from .toxicity import fit_toxicity, toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 of low quality, 1 of good quality but toxic, 2 of good quality and not toxic."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    model = fit_quality(docs, labels.select("doc_id", grade.alias("grade")))
    return grade_documents(docs, model)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("item_ids", ","), "utf-8"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_linked", F.sha2(F.encode("base_text", "utf-8"), 256).alias("base_sha256"), F.col("spans_text").alias("spans"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(spark, write_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = identify(docs, fit(docs.where(~held_out), "doc_id", "text", "lang"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = in_training_order(mixture(_table(spark, sf_dir, "documents")))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), num=85, den=100)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumn("failed_signal", F.coalesce("failed_signal", F.lit("-")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_verdicts(_table(spark, sf_dir, "documents"), short=True)
    return found.select("doc_id", "n_lines", "n_equal", "n_near", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), share=(10, 100), min_words=20, least=1, most=1)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = toxicity_scores(docs, fit_toxicity(docs.where(~held_out), labels.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 50 == 0)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_shards": op4_token_shards,
    "op5_language_id": op5_language_id,
    "op6_source_mixing": op6_source_mixing,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_html_extraction": op9_html_extraction,
    "op10_line_dedup": op10_line_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_toxicity": op12_toxicity,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Windows of 13 words (an item of fewer is one window), joined to the windows of every document of the same length.
_OP2_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT item_id, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM item WHERE len(w) > 0
), pat AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM win
), doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), dwin AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM doc, (SELECT DISTINCT size FROM pat) WHERE len(w) >= size
), hit AS (
  SELECT r, i, d.size, item_id FROM (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM dwin) d JOIN pat USING (size, s)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r
), ids AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""

#: CRC-32 by its table of 256 entries, over the bytes of each distinct word.
_OP11_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), w AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM w
), long AS (
  SELECT side, r, unnest(ws) AS word FROM words
), crc AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(hex(word)), 2), lambda i: ('0x' || substr(hex(word), i, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM long), crc_table
), count AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM long JOIN crc USING (word) GROUP BY bucket
), total AS (
  SELECT count(*) FILTER (side = 0) AS s_all, count(*) FILTER (side = 1) AS t_all FROM long
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (t_all + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM count, total
), doc AS (
  SELECT r, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM long JOIN crc USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN doc USING (r) WHERE side = 0
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS eligible FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= 10 * eligible // 100 THEN n END AS rank FROM scored LEFT JOIN placed USING (r)
"""

_OP13_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": _OP2_SQL,
    "op8_quality_rules": quality_rules_sql(),
    "op11_importance_resampling": _OP11_SQL,
    "op13_hard_negatives": _OP13_SQL,
}
