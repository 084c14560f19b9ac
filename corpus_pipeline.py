"""The training-data pipeline: stages over documents, each a table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.llm.decontamination import clean_rows
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.secrets import redacted
from tidemark.llm.toxicity import fitted, scored

#: Near-duplicates share four fifths of their five-word shingles.
SIMILARITY = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives 0.5 or more go; the others stay as they are."""
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(False))
    judged = scored(docs, model, keep=True)
    return judged.where(F.col(judged.columns[-1]) < 0.5).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest id; a null id comes last.

    Rows are told apart by a staged key, so those with null or repeated ids are
    judged like any other.
    """
    key = "_row"
    while key.lower() in (c.lower() for c in docs.columns):
        key += "_"
    rows = stage(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows, SIMILARITY, id_col=key).select(F.col("doc_id").alias(key), F.col("component_id").alias("_group"))
    # Only rows that another one is linked with are asked for their ids.
    several = stage(groups.groupBy("_group").agg(F.count("*").alias("n")).where("n > 1").select("_group"), "several")
    linked = stage(groups.join(several, "_group", "left_semi"), "linked").join(rows.select(key, "doc_id"), key)
    linked = stage(linked.select("_group", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(key).alias("row")).alias("place")), "places")
    first = linked.groupBy("_group").agg(F.min("place").alias("first"))
    stays = stage(first.select(F.col("first.row").alias(key)), "first")
    goes = stage(linked.select(F.col("place.row").alias(key)).join(stays, key, "left_anti"), "repeats")
    return rows.join(goes, key, "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, in one piece or reordered, go."""
    return clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are replaced by a mark and ``n_chars`` follows."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is staged in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs


#: Training, signatures and tokenizing have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
