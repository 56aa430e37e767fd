"""The corpus operators as queries over the test tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontam, exact_dedup, language_model, mixing, ngram_join, quality, secrets_scan, sharding, token_coder, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_model(spark, sf_dir):
    return language_model.score_documents(_table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontam.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark, sf_dir):
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"))


def op7_token_blocks(spark, sf_dir):
    return token_coder.token_blocks(_table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secrets_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op9_ngram_join(spark, sf_dir):
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_language_model, op2_quality, op3_exact_dedup, op4_sharding, op5_decontamination, op6_url_filter, op7_token_blocks, op8_secrets, op9_ngram_join, op10_mixing)}


def oracle_sql():
    return {"op3_exact_dedup": exact_dedup.ORACLE, "op5_decontamination": decontam.ORACLE, "op6_url_filter": urlfilter.oracle(), "op9_ngram_join": ngram_join.ORACLE, "op10_mixing": mixing.ORACLE}
