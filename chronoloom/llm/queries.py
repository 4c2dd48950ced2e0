"""The registered queries of the text operators: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, html, licenses, minhash, pieces, quality, suffix, toxicity, urls, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = quality.scored(_table(spark, sf_dir, "documents"), quality.graded(_table(spark, sf_dir, "labels")))
    return graded.withColumn("keep", F.col("p1") >= 0.5)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(_table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a page is to be blocked if the labels of its number call it bad
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 or toxic = 1").alias("block"))
    return urls.judged(_table(spark, sf_dir, "pages"), labels)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited(_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.expr("crc32(cast(doc_id as string)) % 4 = 2")
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    judged = toxicity.judged(_table(spark, sf_dir, "documents"), labels)
    return judged.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_quality, op3_sentencepiece, op4_decontaminate, op5_suffix, op6_urls, op7_licenses, op8_winnow, op9_minhash, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op7_licenses": licenses.sql(), "op8_winnow": winnow.sql()}
