"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD_OUT, fold, table


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embed_dedup

    found = embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


OP1_SQL = r"""
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    spans = F.col("pii_spans")
    return pii.with_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[pii.count_of(spans, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.listed(spans, base_only=True), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), "severity", "grade", (F.col("grade") > 0).alias("toxic"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select(F.col("id").alias("doc_id"), (fold("id") == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return quality.with_score(docs, model).select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "score", predicted.alias("predicted"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_store

    store = token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read(store).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    found = lm.score(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).otherwise(0.0)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "n_backed_off", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda w: w <> '') AS w FROM documents
), tokens AS (
  SELECT doc_id, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS b1, CASE WHEN i > 2 THEN w[i - 2] END AS b2 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), own1 AS (SELECT doc_id, word, count(*) AS n FROM tokens GROUP BY ALL), one AS (SELECT word, sum(n) AS n FROM own1 GROUP BY word),
own2 AS (SELECT doc_id, b1, word, count(*) AS n FROM tokens WHERE b1 IS NOT NULL GROUP BY ALL), two AS (SELECT b1, word, sum(n) AS n FROM own2 GROUP BY ALL),
own3 AS (SELECT doc_id, b2, b1, word, count(*) AS n FROM tokens WHERE b2 IS NOT NULL GROUP BY ALL), three AS (SELECT b2, b1, word, sum(n) AS n FROM own3 GROUP BY ALL),
rest1 AS (SELECT doc_id, word, one.n - own1.n AS n FROM own1 JOIN one USING (word)),
rest2 AS (SELECT doc_id, b1, word, two.n - own2.n AS n FROM own2 JOIN two USING (b1, word)),
rest3 AS (SELECT doc_id, b2, b1, word, three.n - own3.n AS n FROM own3 JOIN three USING (b2, b1, word)),
size AS (SELECT count(*) AS n FROM tokens), lengths AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
counted AS (
  SELECT t.doc_id, (t.b1 IS NOT NULL)::BIGINT + (t.b2 IS NOT NULL)::BIGINT AS allowed, greatest(1, r1.n)::DOUBLE AS n1, r2.n AS n2, r3.n AS n3, h1.n AS h1, h2.n AS h2, greatest(1, (SELECT n FROM size) - l.n)::DOUBLE AS others
  FROM tokens t JOIN lengths l ON l.doc_id = t.doc_id JOIN rest1 r1 ON r1.doc_id = t.doc_id AND r1.word = t.word
  LEFT JOIN rest2 r2 ON r2.doc_id = t.doc_id AND r2.b1 = t.b1 AND r2.word = t.word AND r2.n > 0
  LEFT JOIN rest3 r3 ON r3.doc_id = t.doc_id AND r3.b2 = t.b2 AND r3.b1 = t.b1 AND r3.word = t.word AND r3.n > 0
  LEFT JOIN rest1 h1 ON h1.doc_id = t.doc_id AND h1.word = t.b1 LEFT JOIN rest2 h2 ON h2.doc_id = t.doc_id AND h2.b1 = t.b2 AND h2.word = t.b1
), scored AS (
  SELECT doc_id, allowed - CASE WHEN n3 IS NOT NULL THEN 2 WHEN n2 IS NOT NULL THEN 1 ELSE 0 END AS back,
    CASE WHEN n3 IS NOT NULL THEN ln(n3::DOUBLE) - ln(h2::DOUBLE) WHEN n2 IS NOT NULL THEN ln(n2::DOUBLE) - ln(h1::DOUBLE) ELSE ln(n1) - ln(others) END AS v
  FROM counted
), sums AS (SELECT doc_id, count(*) AS n, sum((back > 0)::BIGINT)::BIGINT AS b, sum(v + back * ln(0.4::DOUBLE)) AS s FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_tokens, coalesce(b, 0)::BIGINT AS n_backed_off, round(coalesce(s, 0), 4) AS log_score, round(coalesce(s / n, 0), 6) AS mean_log_score
FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    found = decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    share = F.round(F.col("n_found") / F.col("n_shingles"), 6)
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_shingles", "n_found", share.alias("containment"))


OP10_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda w: w <> '') FROM benchmark
), shingles AS (
  SELECT DISTINCT side, id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT side, id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, z.n AS n_shingles, count(*) AS n_found, round(count(*)::DOUBLE / z.n, 6) AS containment
FROM shingles d JOIN shingles i ON d.side = 'd' AND i.side = 'i' AND d.s = i.s JOIN sizes z ON z.id = i.id
GROUP BY d.id, i.id, z.n HAVING count(*) >= 0.8 * z.n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_embedding_dedup": op1_embedding_dedup, "op2_pii": op2_pii, "op3_toxicity": op3_toxicity, "op4_language": op4_language, "op5_quality": op5_quality, "op6_token_store": op6_token_store, "op7_simhash": op7_simhash, "op8_byte_bpe": op8_byte_bpe, "op9_lm_score": op9_lm_score, "op10_decontamination": op10_decontamination}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op9_lm_score": OP9_SQL, "op10_decontamination": OP10_SQL}
