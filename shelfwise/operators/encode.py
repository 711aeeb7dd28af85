"""Vocabularies and the encoded item and user rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import pricing
from shelfwise.operators.scan import running_totals
from shelfwise.params import PRICE_TIERS


def vocabulary(values: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values numbered from 1; 0 is left for unknown ones."""
    distinct = values.select(F.col(column).alias("value")).where("value IS NOT NULL AND value <> ''").distinct()
    return running_totals(distinct, [], [F.col("value")], out="idx")


def tier_vocabulary(spark: SparkSession) -> DataFrame:
    return vocabulary(spark.createDataFrame([(t,) for t in PRICE_TIERS], "tier string"), "tier")


def lookup(rows: DataFrame, vocab: DataFrame, column: str, alias: str) -> DataFrame:
    """Adds the vocabulary index of `column`, 0 for NULL and unknown values."""
    v = vocab.select(F.col("value").alias(column), F.col("idx").alias(f"_{alias}"))
    return rows.join(v, column, "left").withColumn(alias, F.coalesce(f"_{alias}", F.lit(0)).cast("bigint")).drop(f"_{alias}")


def encode_items(products: DataFrame, embeddings: DataFrame, categories: DataFrame, brands: DataFrame, tiers: DataFrame) -> DataFrame:
    """Ids, nine numerics and the vector of every product that has a vector."""
    rows = products.join(embeddings, "product_id")
    for vocab, column, alias in ((categories, "category_name", "category_id_enc"), (brands, "brand", "brand_id_enc"), (tiers, "price_tier", "price_tier_id_enc")):
        rows = lookup(rows, vocab, column, alias)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return rows.select(
        "product_id", "category_id_enc", "brand_id_enc", "price_tier_id_enc",
        pricing.normalised(F.col("effective_price"), F.col("max_price")).alias("normalized_price"), (F.col("discount_percentage") / 100).alias("discount_fraction"),
        F.log1p("purchase_count").alias("log_purchase_count"), F.log1p("cart_add_count").alias("log_cart_add_count"), F.log1p("review_count").alias("log_review_count"),
        F.coalesce("average_rating", F.lit(0.0)).alias("average_rating"), flag(F.col("average_rating").isNotNull()).alias("has_rating"),
        "category_relative_price", flag(F.col("is_discounted")).alias("is_discounted"), "embedding")


def encode_users(features: DataFrame, categories: DataFrame, brands: DataFrame, ages: DataFrame, tiers: DataFrame, max_price, dim: int) -> DataFrame:
    """Ids, nine numerics, dense affinities by vocabulary slot, and the vector (zeros where there is none)."""
    cats = categories.agg(F.array_sort(F.collect_list("value")).alias("v")).scalar()
    brs = brands.agg(F.array_sort(F.collect_list("value")).alias("v")).scalar()
    rows = features.withColumn("max_price", max_price).withColumn("_cats", cats).withColumn("_brands", brs)
    for vocab, column, alias in ((categories, "preferred_category", "preferred_category_id_enc"), (ages, "age_group", "age_group_id_enc"), (tiers, "price_tier", "price_tier_id_enc")):
        rows = lookup(rows, vocab, column, alias)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    dense = lambda names, weights: F.expr(f"transform({names}, n -> coalesce(try_element_at({weights}, n), 0D))")
    return rows.select(
        "example_id", "user_id", "preferred_category_id_enc", "age_group_id_enc", "price_tier_id_enc",
        F.log1p("purchase_count").alias("log_purchase_count"), F.log1p("cart_item_count").alias("log_cart_item_count"), F.log1p("search_count").alias("log_search_count"),
        F.log1p("total_engagement_events").alias("log_total_engagement_events"), flag(F.col("has_chatbot_context")).alias("has_chatbot_context"),
        flag(F.col("preferred_category").isNotNull()).alias("has_preferred_category"), flag(F.col("age_group").isNotNull()).alias("has_age_group"),
        flag(F.col("vector").isNotNull()).alias("has_semantic_embedding"),
        F.coalesce(pricing.normalised(F.col("typical_price"), F.col("max_price")), F.lit(0.0)).alias("normalized_typical_price"),
        dense("_cats", "category_affinity").alias("category_affinity"), dense("_brands", "brand_affinity").alias("brand_affinity"),
        F.coalesce("vector", F.expr(f"array_repeat(0D, {dim})")).alias("vector"))


def save_vocabularies(vocabs: dict[str, DataFrame], max_price: DataFrame, path: str) -> None:
    for name, v in vocabs.items():
        v.write.mode("overwrite").parquet(f"{path}/vocab_{name}")
    max_price.write.mode("overwrite").parquet(f"{path}/max_price")


def load_vocabularies(spark: SparkSession, names: list[str], path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    return {n: spark.read.parquet(f"{path}/vocab_{n}") for n in names}, spark.read.parquet(f"{path}/max_price")


def in_batch_softmax(pairs: DataFrame, batches: int, temperature: float) -> DataFrame:
    """Loss and hit of every (user vector, item vector) row against the items of its batch. Batches are small by
    construction (rows / batches), and each emits one row per pair. Equal items of a batch are multiplied once, so that they score the same, and
    scores are compared at 9 digits; of equal ones the lowest row is taken."""
    import numpy as np
    import pyarrow as pa

    def one(table: pa.Table) -> pa.Table:
        from shelfwise.operators.retrieval import _matrix, _unit
        table = table.sort_by("row_id")
        items, same = np.unique(_matrix(table.column("item_vector")), axis=0, return_inverse=True)
        logits = ((_unit(_matrix(table.column("user_vector"))) @ _unit(items).T) / temperature)[:, same.ravel()]
        top = logits.max(axis=1)
        loss = top + np.log(np.exp(logits - top[:, None]).sum(axis=1)) - np.diag(logits)
        hit = np.argmax(np.round(logits, 9), axis=1) == np.arange(len(loss))
        return pa.table({"row_id": table.column("row_id"), "batch": table.column("batch"), "loss": pa.array(loss), "hit": pa.array(hit)})

    batch = F.pmod(F.conv(F.substring(F.md5(F.col("row_id").cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(batches))
    rows = pairs.select("row_id", "user_vector", "item_vector").withColumn("batch", batch)
    return rows.groupBy("batch").applyInArrow(one, "row_id bigint, batch bigint, loss double, hit boolean")
