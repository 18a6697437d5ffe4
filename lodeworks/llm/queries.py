"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extraction, ngram_join, ngram_lm, packing, source_mixing, token_counts, toxicity, url_filter, vector_dedup, vector_search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels outside the held-out fold."""
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(4) != 2)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learnt from the labelled rows of documents outside the held-out fold."""
    return toxicity.fit(docs, toxicity_labels(spark, sf_dir))


def op1_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.learn_and_score(table(spark, sf_dir, "documents"), F.coalesce(fold(7), F.lit(0)) == 2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.learn_and_score(table(spark, sf_dir, "documents"), toxicity_labels(spark, sf_dir))
    return scored.select("doc_id", (F.coalesce(fold(4), F.lit(0)) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_search.search(vectors, asked)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dup, op2_source_mixing, op3_lm_scoring, op4_toxicity, op5_html_extraction, op6_ann_search,
        op7_url_filter, op8_token_counts, op9_ngram_jaccard_join, op10_packing, pipeline,
    )
}

ORACLES = {
    "op2_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3.0::DOUBLE * source_size / ((place - 1) % 3 + 1) AS ratio FROM t),
c AS (SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
             coalesce(sum(source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_size,
             coalesce(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_weight FROM w),
v AS (SELECT *, (all_size - 3.0::DOUBLE * capped_size) / (all_weight - capped_weight) AS level FROM c),
g AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce((SELECT level FROM v WHERE ratio >= level ORDER BY ratio, place LIMIT 1), 0.0) * weight) AS target FROM v),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start,
             CASE WHEN g.source_size > 0 THEN floor(floor(g.target) / g.source_size)::BIGINT ELSE 0 END AS whole
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - start)))::BIGINT AS taken
FROM p""",
}
