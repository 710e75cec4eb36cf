"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.llm import alignment, exact_dedup, minhash, mixing, packing, pii, quality, secrets, sharding, simhash, suffix_dedup
from spanloom.llm import toxicity, whitening
from spanloom.llm.common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    n_spans = F.size("spans").cast("long")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), n_spans.alias("n_spans"), "kept_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, labels(spark, sf_dir), where=toxicity.learning_rows())
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(~toxicity.learning_rows(), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    mixed = mixing.mix(docs, F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(documents(spark, sf_dir))
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), fingerprint.alias("fingerprint"), F.col("component").alias("component_id"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.mark_copies(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = quality.judge(docs, quality.learn(docs, labels(spark, sf_dir)))
    return judged.drop("probability")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.learn(docs))
    counts = [_count("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, _sha("base").alias("base_sha256"), _line("spans").alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.find(docs, secrets.learn(docs))
    counts = [_count("base", k).alias(f"n_{k}") for k, *_ in secrets.FORMS]
    return found.select("doc_id", *counts, _sha("base").alias("base_sha256"), _line("spans").alias("spans"))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _line(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""

    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def _sha(spans: str) -> Column:
    return F.sha2(F.encode(_line(spans), "utf-8"), 256)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(documents(spark, sf_dir))
    return found.withColumnRenamed("id", "doc_id").withColumn("grown_shard", F.lit(None).cast("int"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = whitening.learn(rows)
    error = None if model is None else whitening.identity_error(rows, model)
    n, error = F.lit(model.n if model else 0).cast("long"), F.lit(error).cast("double")
    found = whitening.whiten(rows, model).withColumns({"n": n, "identity_error": error})
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_minhash": op12_minhash,
    "op13_alignment": op13_alignment,
}

_OP4 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
-- A source is full if it is when all with a smaller limit for each weight are.
o AS (
  SELECT *, sum(source_size) OVER () AS all_words,
    coalesce(sum(source_size) OVER w, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left
  FROM s WINDOW w AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, weight * (3 * all_words - 4 * full_before) > 2 * weight_left * 2 * source_size AS is_full FROM o),
r AS (
  SELECT sum(CASE WHEN is_full THEN source_size ELSE 0 END) AS full_words, sum(CASE WHEN is_full THEN 0 ELSE weight END) AS open_weight FROM f),
t AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN (2 * source_size)::DOUBLE
      ELSE (weight * (3 * all_words - 4 * full_words))::DOUBLE / (2 * open_weight)::DOUBLE END AS target
  FROM f, r),
c AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size = 0 THEN 0 ELSE least(2, floor(target / source_size)) END AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, '')), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0
    ELSE least(2, whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) * size END)::BIGINT AS taken
FROM c
"""

_OP6 = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

_OP12 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    ELSE list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
g AS (SELECT doc_id, len(shingles) AS n, hash(unnest(shingles)) AS h FROM s),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id,
  doc_id <= coalesce(c.least, doc_id) AS kept
FROM s LEFT JOIN c ON s.doc_id = c.x
"""

ORACLES = {"op4_mixing": _OP4, "op6_exact_dedup": _OP6, "op12_minhash": _OP12}
