"""Ranking rows: the 29 features of a (user, candidate) pair, labels, negatives, model order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions import pricing, vectors
from shelfwise.operators.loo import sample_key
from shelfwise.sources.stage import stage

_SPARE_DRAWS = 8  # drawn beyond what a sample needs, for items that turn out to be bought

# Feature names in model order.
USER_FEATURES = (
    "user_log_purchase_count", "user_log_cart_item_count", "user_log_search_count", "user_log_total_engagement_events",
    "user_has_chatbot_context", "user_has_preferred_category", "user_has_age_group")
ITEM_FEATURES = (
    "item_normalized_price", "item_discount_fraction", "item_log_purchase_count", "item_log_cart_add_count", "item_log_review_count",
    "item_average_rating", "item_has_rating", "item_log_stock_quantity", "item_is_active", "item_category_relative_price", "item_is_discounted")
CROSS_FEATURES = (
    "category_affinity_match", "brand_affinity_match", "preferred_category_match", "semantic_cosine_similarity", "has_semantic_similarity",
    "user_normalized_typical_price", "user_has_price_profile", "price_relative_distance", "price_tier_match")
RETRIEVAL_FEATURES = ("retrieval_score", "retrieval_rank_normalized")
FEATURES = USER_FEATURES + ITEM_FEATURES + CROSS_FEATURES + RETRIEVAL_FEATURES


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def affinity_of(weights: Column, name: Column) -> Column:
    """Weight of `name` in an affinity map, 0 where it is missing."""
    return F.coalesce(F.try_element_at(weights, F.coalesce(name, F.lit(""))), F.lit(0.0))


def feature_rows(candidates: DataFrame, features: DataFrame, products: DataFrame, embeddings: DataFrame, pool: int) -> DataFrame:
    """`candidates` (example_id, product_id, retrieval_score, retrieval_rank from 0, ...) with all features added;
    other columns stay. Products unknown to the catalog drop out."""
    u = features.select("example_id", F.col("purchase_count").alias("u_purchases"), "cart_item_count", "search_count", "total_engagement_events",
                        "has_chatbot_context", "preferred_category", "age_group", "category_affinity", "brand_affinity", F.col("vector").alias("u_vector"), vectors.norm(F.col("vector")).alias("u_norm"),
                        "typical_price", F.col("price_tier").alias("u_tier"))
    e = embeddings.select("product_id", F.col("embedding").alias("i_vector"), vectors.norm(F.col("embedding")).alias("i_norm"))
    p = products.join(e, "product_id", "left")
    j = candidates.join(p, "product_id").join(u, "example_id")  # rows with an item's columns are the narrower ones to move on
    c = F.col
    both = F.coalesce((c("u_norm") > 0) & (c("i_norm") > 0), F.lit(False))  # lengths are measured once per example and product, not per pair
    values = {
        "user_log_purchase_count": F.log1p("u_purchases"), "user_log_cart_item_count": F.log1p("cart_item_count"),
        "user_log_search_count": F.log1p("search_count"), "user_log_total_engagement_events": F.log1p("total_engagement_events"),
        "user_has_chatbot_context": _flag(c("has_chatbot_context")), "user_has_preferred_category": _flag(c("preferred_category").isNotNull()),
        "user_has_age_group": _flag(c("age_group").isNotNull()),
        "item_normalized_price": pricing.normalised(c("effective_price"), c("max_price")),
        "item_discount_fraction": F.coalesce("discount_percentage", F.lit(0.0)) / 100.0,
        "item_log_purchase_count": F.log1p("purchase_count"), "item_log_cart_add_count": F.log1p("cart_add_count"), "item_log_review_count": F.log1p("review_count"),
        "item_average_rating": F.coalesce("average_rating", F.lit(0.0)), "item_has_rating": _flag(c("average_rating").isNotNull()),
        "item_log_stock_quantity": F.log1p("stock_quantity"), "item_is_active": _flag(c("is_active")),
        "item_category_relative_price": c("category_relative_price"), "item_is_discounted": _flag(c("is_discounted")),
        "category_affinity_match": affinity_of(c("category_affinity"), c("category_name")), "brand_affinity_match": affinity_of(c("brand_affinity"), c("brand")),
        "preferred_category_match": _flag(c("preferred_category") == c("category_name")),
        "semantic_cosine_similarity": F.when(both, vectors.dot(c("u_vector"), c("i_vector")) / (c("u_norm") * c("i_norm"))).otherwise(F.lit(0.0)), "has_semantic_similarity": _flag(both),
        "user_normalized_typical_price": F.coalesce(pricing.normalised(c("typical_price"), c("max_price")), F.lit(0.0)),
        "user_has_price_profile": _flag(c("typical_price").isNotNull()), "price_relative_distance": pricing.relative_distance(c("effective_price"), c("typical_price")),
        "price_tier_match": _flag(c("u_tier") == c("price_tier")),
        "retrieval_score": c("retrieval_score"), "retrieval_rank_normalized": c("retrieval_rank") / float(max(pool - 1, 1)),
    }
    keep = [n for n in candidates.columns if n not in ("retrieval_score", "retrieval_rank")]
    return j.select(*keep, *[values[n].cast("double").alias(n) for n in FEATURES])


def check_feature_columns(saved: list[str]) -> None:
    """A stored model only fits if its feature names are ours, in our order."""
    if list(saved) != list(FEATURES):
        raise ValueError(f"ranker was trained on other features:\n  saved:    {list(saved)}\n  expected: {list(FEATURES)}")


def score_and_rank(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """Retrieval score and rank (from 0) of `wanted` (example_id, product_id, ...); an item that was not retrieved
    gets the list's lowest score and its length."""
    lists = hits.groupBy(F.col("query_id").alias("example_id")).agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("length"))
    found = hits.select(F.col("query_id").alias("example_id"), F.col("item_id").alias("product_id"), F.col("score").alias("s"), (F.col("rank") - 1).alias("r"))
    j = wanted.join(lists, "example_id", "left").join(found, ["example_id", "product_id"], "left")
    return j.select(*wanted.columns, F.coalesce("s", "worst", F.lit(0.0)).alias("retrieval_score"), F.coalesce("r", "length", F.lit(0)).cast("bigint").alias("retrieval_rank"))


def retrieved_negatives(hits: DataFrame, wanted: DataFrame, purchased: DataFrame, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Sampled retrieved items the user never buys: `wanted` has (example_id, user_id, salt, needed) and the columns `by`, if an
    example wants several samples. Sampling orders by a hash of seed, user, salt and item, without replacement. Lists are at most one pool long.

    Only the first draws of a list, a few more than needed, are looked up among the purchases; where too few of them are
    left, the whole list is, so that no sample is short of what its list holds."""
    keys = ["example_id", *by]
    bought = purchased.select("user_id", "product_id").distinct().withColumn("bought", F.lit(True))
    last = F.col("needed") + _SPARE_DRAWS
    drawn = _drawn(hits, wanted, seed).withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("draw", "product_id"))).where(F.col("place") <= last)
    whole = W.partitionBy(*keys)
    free = F.col("bought").isNull().cast("int")
    seen = drawn.drop("draw").join(bought, ["user_id", "product_id"], "left").withColumn("pick", F.sum(free).over(whole.orderBy("place")))
    seen = seen.withColumn("short", (F.max("place").over(whole) >= last) & (F.sum(free).over(whole) < F.col("needed")))
    seen = stage(seen.where("short OR (bought IS NULL AND pick <= needed)"), "first_draws")
    cols = [*keys, "user_id", "product_id", "retrieval_score", "retrieval_rank"]
    out = seen.where("NOT short").select(*cols)
    short = seen.where("short").select(*keys).distinct()
    if short.isEmpty():
        return out
    rows = _drawn(hits, wanted.join(short, keys, "left_semi"), seed).join(bought, ["user_id", "product_id"], "left_anti")
    rest = rows.withColumn("pick", F.row_number().over(W.partitionBy(*keys).orderBy("draw", "product_id"))).where("pick <= needed")
    return out.unionByName(rest.select(*cols))


def _drawn(hits: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    pool = hits.select(F.col("query_id").alias("example_id"), F.col("item_id").alias("product_id"), F.col("score").alias("retrieval_score"), (F.col("rank") - 1).alias("retrieval_rank"))
    return pool.join(wanted, "example_id").withColumn("draw", sample_key(seed, "user_id", "salt", "product_id"))


def order_by_model(scored: DataFrame) -> DataFrame:
    """(query_id, item_id, rank, model_score) with `position` by model score, ties in retrieval order."""
    best = W.partitionBy("query_id").orderBy(F.col("model_score").desc(), "rank", "item_id")
    return scored.withColumn("position", F.row_number().over(best).cast("bigint"))
