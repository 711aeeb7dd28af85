"""Stored product vectors with model name and content hash, refreshed incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.text import content_hash
from shelfwise.operators.textvec import Encoder


def save(vectors: DataFrame, path: str, model_name: str) -> None:
    """`vectors`: product_id, embedding, content_hash."""
    vectors.select("product_id", F.col("embedding").cast("array<float>").alias("embedding"), "content_hash", F.lit(model_name).alias("model_name")).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("product_id bigint, embedding array<float>, content_hash string, model_name string").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path).select("product_id", "embedding")


def plan_refresh(current: DataFrame, stored: DataFrame, model_name: str) -> DataFrame:
    """What to do per product id: `keep`, `encode` (new, changed text, other model) or `drop`. `current` has
    (product_id, content_hash), `stored` (product_id, content_hash, model_name)."""
    old = stored.select("product_id", F.col("content_hash").alias("old_hash"), "model_name")
    j = current.select("product_id", "content_hash").join(old, "product_id", "full_outer")
    same = (F.col("content_hash") == F.col("old_hash")) & (F.col("model_name") == model_name)
    return j.select("product_id", F.when(F.col("content_hash").isNull(), "drop").when(F.coalesce(same, F.lit(False)), "keep").otherwise("encode").alias("action"))


def refresh(texts: DataFrame, stored: DataFrame | None, encoder: Encoder, model_name: str, force: bool = False) -> tuple[DataFrame, bool]:
    """Vectors for `texts` (product_id, text), reusing stored rows that still fit; the flag tells whether anything
    had to be encoded or dropped."""
    current = texts.withColumn("content_hash", content_hash(F.col("text")))
    if stored is None or force:
        fresh, kept, changed = current, None, True
    else:
        actions = plan_refresh(current, stored, model_name)
        fresh = current.join(actions.where("action = 'encode'"), "product_id", "left_semi")
        kept = stored.join(actions.where("action = 'keep'"), "product_id", "left_semi").select("product_id", "embedding", "content_hash")
        changed = not actions.where("action <> 'keep'").isEmpty()
    coded = fresh.join(encoder(fresh.select("text")), "text").select("product_id", "embedding", "content_hash")
    return (coded if kept is None else kept.unionByName(coded)), changed
