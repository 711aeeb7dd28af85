"""From raw documents to packed training sequences: five stages, each one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import exact_dedup, language_id, near_dedup, packing, pii
from shelfwise.sources.ship import ship
from shelfwise.sources.stage import stage

#: Several stages fit models or follow links, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided; the others, which have no letters or no likely language, go."""
    ship(spark)
    return language_id.accepted(docs, language_id.fit(docs, "text", "lang", "doc_id"), "text", declared_column="lang", host_column="source")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship(spark)
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    ship(spark)
    dropped = near_dedup.near_groups(docs.select("doc_id", "text")).where("NOT kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars follows the text."""
    ship(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("language_id", languages), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
