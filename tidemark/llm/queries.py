"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import clustering, decontaminate, embedding_dedup, fill_in_middle, html_extract, language, licences, ngram_join, packing, quality, secrets, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality.train(documents, _table(spark, sf_dir, "labels"))
    scored = quality.score(documents, model)
    held_out = F.coalesce(quality.bucket("doc_id", 4) == 2, F.lit(False))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"))


OP2_SQL = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id <> lo THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id <> lo THEN lo END AS refers_to
FROM (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS lo
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(_table(spark, sf_dir, "documents")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicate(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.match(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = language.predict(documents, language.train(documents))
    held_out = F.coalesce(quality.bucket("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.restore(fill_in_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc_roundtrip": op2_warc_roundtrip,
    "op3_html_extraction": op3_html_extraction,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_ngram_join": op6_ngram_join,
    "op7_licence_scan": op7_licence_scan,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_top_k": op13_exact_top_k,
}
ORACLE_SQL = {
    "op2_warc_roundtrip": OP2_SQL,
    "op5_secret_scan": secrets.oracle_sql(),
    "op6_ngram_join": ngram_join.oracle_sql(3, 90),
    "op7_licence_scan": licences.oracle_sql(),
    "op8_embedding_dedup": embedding_dedup.oracle_sql(),
    "op9_decontamination": decontaminate.oracle_sql(),
    "op11_centroid_clustering": clustering.oracle_sql(),
    "op12_fill_in_middle": fill_in_middle.oracle_sql(),
    "op13_exact_top_k": topk.oracle_sql(),
}
