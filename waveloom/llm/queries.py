"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import joined, sanitised

    found = sanitised(_documents(spark, sf_dir), texts=False)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"), count(3).alias("n_phone"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import matches

    return matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scanned

    docs = _documents(spark, sf_dir)
    return scanned(docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("path"), "text"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import round_trip

    return round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), special=True)


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import repeated

    return repeated(_documents(spark, sf_dir)).drop("spans")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, scored

    docs = scored(_documents(spark, sf_dir).select("doc_id", "text"), _labels(spark, sf_dir))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out
    from .toxicity import scored

    docs = scored(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_pred").alias("predicted"), "n_offending", "worst_start", "worst_end")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    docs = mixed(_documents(spark, sf_dir))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import joined, scanned

    found = scanned(_documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = joined(F.filter("found", lambda s: s["kind"] < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_licenses, op4_token_ids, op5_suffix, op6_simhash, op7_quality, op8_mixing, op9_toxicity, op10_embeddings, op11_whitening, op12_negatives, op13_secrets)}

SQL = {
    "op8_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5.0, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS w, 3 * source_size AS cap FROM sources
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS caps,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) - caps)::DOUBLE / rest AS level FROM ordered
), level AS (
  SELECT arg_min(level, k) AS level FROM levels WHERE cap > w * level
), goals AS (
  SELECT source, source_size, least(cap::DOUBLE, w * coalesce((SELECT level FROM level), 0)) AS target FROM weighed
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0 AS u
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN size * (floor(rate) + (u < rate - floor(rate))::BIGINT) ELSE 0 END AS BIGINT) AS taken FROM rated
""",
    "op12_negatives": r"""
WITH whole AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(CAST(c AS DOUBLE)))) = 0
), scores AS (
  SELECT a.rid AS rid, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.rid <> b.rid
), positives AS (
  SELECT rid, anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.rid, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.rid = n.rid AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.rid, p.positive_id ORDER BY n.score DESC, n.id) <= 3
""",
    "op13_secrets": r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), patterns(kind, name, pattern, lead, least) AS (
  VALUES (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?', 8),
    (1, 'access', 'AKIA[A-Z0-9]+', '', 16), (2, 'hex', '[0-9a-f]+', '', 32), (3, 'pem', '-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----', '', 0),
    (4, 'github', '\bgh[pousr]_[A-Za-z0-9]{36,}', '', 0), (5, 'slack', '\bxox[abeprs]-[A-Za-z0-9-]{10,}', '', 0), (6, 'jwt', '\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', '', 0)
), hits AS (
  SELECT rid, kind, name, lead, least, regexp_extract_all(t, pattern) AS h, string_split_regex(t, pattern) AS g FROM texts, patterns WHERE regexp_matches(t, pattern)
), each AS (
  SELECT rid, kind, name, lead, least, unnest(h) AS hit, unnest(list_transform(g[1:len(h)], lambda x: length(x))) AS gap, unnest(range(1, len(h) + 1)) AS k FROM hits
), placed AS (
  SELECT *, CAST(sum(gap + length(hit)) OVER (PARTITION BY rid, kind ORDER BY k) AS BIGINT) AS e FROM each
), kept AS (
  SELECT rid, kind, e - length(hit) AS s, name || ':' || CAST(e - length(hit) AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS span FROM placed WHERE length(regexp_replace(hit, lead, '')) >= least
), folded AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans
  FROM kept GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN folded USING (rid)
""",
}
