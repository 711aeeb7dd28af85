"""Fallback candidate sources and the two ways of merging candidate lists.

Only the first `pool` products of a popularity list can reach a merged pool: whatever lies behind them has
`pool` better rows of the same source ahead of it. The lists joined to users are therefore at most `pool` rows
per category, and cutting them loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.operators.ranks import rank_score
from shelfwise.params import ColdStart


def history_tier(total_events, params: ColdStart):
    return (F.when(total_events >= params.strong_history_min_signals, "strong")
            .when(total_events >= params.sparse_history_min_signals, "sparse").otherwise("no_history"))


def popularity_order():
    return [F.col("purchase_count").desc(), F.col("cart_add_count").desc(), F.col("product_id")]


def global_top(eligible: DataFrame, pool: int) -> DataFrame:
    """First `pool` eligible products with their score over the whole list and, for the merge, their rank in
    their own category."""
    top = eligible.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*popularity_order()))).where(F.col("rank") <= pool)
    size = eligible.agg(F.count(F.lit(1)).alias("n")).scalar()
    return top.select("product_id", "category_name", "rank", size.alias("list_size"))


def category_top(eligible: DataFrame, pool: int) -> DataFrame:
    """First `pool` eligible products of every category, with the size of the whole category list."""
    by_cat = W.partitionBy("category_name").orderBy(*popularity_order())
    known = eligible.where("category_name IS NOT NULL")
    top = known.withColumn("rank", F.row_number().over(by_cat)).where(F.col("rank") <= pool)
    sizes = known.groupBy("category_name").agg(F.count(F.lit(1)).alias("list_size"))
    return top.join(sizes, "category_name").select("category_name", "product_id", "rank", "list_size")


def category_rank_of(products: DataFrame, eligible: DataFrame) -> DataFrame:
    """Category rank of a few given products: one plus the number of better products in the category."""
    few = products.select("product_id", "category_name").where("category_name IS NOT NULL").join(
        eligible.select("product_id", "purchase_count", "cart_add_count"), "product_id")
    few = few.select(F.struct((-F.col("purchase_count")).alias("p"), (-F.col("cart_add_count")).alias("c"), F.col("product_id").alias("i")).alias("own"), "product_id", "category_name")
    rivals = eligible.select("category_name", F.struct((-F.col("purchase_count")).alias("p"), (-F.col("cart_add_count")).alias("c"), F.col("product_id").alias("i")).alias("other"))
    # `few` holds at most `pool` products
    counted = rivals.join(F.broadcast(few), "category_name").groupBy("product_id", "category_name").agg(
        F.count(F.when(F.col("other") <= F.col("own"), 1)).alias("rank"), F.count(F.lit(1)).alias("list_size"))
    return counted


def blend(sources: DataFrame, key: str, pool: int) -> DataFrame:
    """Weighted merge of ranked lists: rows (key, source_order, source, weight, product_id, rank, list_size).
    A product keeps its best weighted score; equal scores keep the earlier source, and equal products in the
    final order keep first-seen order."""
    scored = sources.withColumn("score", F.col("weight") * rank_score(F.col("rank"), F.col("list_size")))
    best = scored.groupBy(key, "product_id").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "source_order", "rank", "source", "score")).alias("best"),
        F.min(F.struct("source_order", "rank")).alias("seen"))
    order = W.partitionBy(key).orderBy(F.col("best.score").desc(), F.col("seen.source_order"), F.col("seen.rank"))
    return best.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= pool).select(
        key, "position", "product_id", F.col("best.score").alias("score"), F.col("best.source").alias("source"))


def waterfall(sources: DataFrame, key: str, pool: int) -> DataFrame:
    """Sources strictly in order, new products only, until the pool is full; each source scores from 1 down."""
    scored = sources.withColumn("score", rank_score(F.col("rank"), F.col("list_size")))
    first = scored.groupBy(key, "product_id").agg(F.min(F.struct("source_order", "rank", "source", "score")).alias("f"))
    order = W.partitionBy(key).orderBy(F.col("f.source_order"), F.col("f.rank"))
    return first.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= pool).select(
        key, "position", "product_id", F.col("f.score").alias("score"), F.col("f.source").alias("source"))
