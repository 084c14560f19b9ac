"""The registered queries of the pipeline operators and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontamination, kneser_ney, licenses, minhash, negatives, packing, secrets, topk, toxicity, urls, variants, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(packing.TOKENIZER)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = topk.quantized(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(table, table.where("vec_id % 50 = 0"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.language_model_scores(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = negatives.prepared(negatives.relabelled(_table(spark, sf_dir, "embeddings")))
    return negatives.hard_negatives(table, F.col("vec_id") % 100 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_url_filters, op3_warc, op4_toxicity, op5_exact_top_k, op6_language_model, op7_benchmark_decontamination, op8_license_scans, op9_minhash_near_dedup, op10_secret_scans, op11_byte_bpe, op12_hard_negatives, op13_spelling_variants)}
SQL: dict[str, str] = {"op2_url_filters": urls.ORACLE, "op3_warc": warc.ORACLE, "op5_exact_top_k": topk.ORACLE, "op8_license_scans": licenses.ORACLE, "op12_hard_negatives": negatives.ORACLE}
