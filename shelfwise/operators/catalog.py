"""Catalog denormalisation and product features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.operators.scan import quantiles
from shelfwise.functions import pricing
from shelfwise.params import EligibilityParams
from shelfwise.sources.bindings import Tables


def tag_arrays(product_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Sorted tag names per product; links to unknown tags are dropped."""
    return (
        product_tags.join(tags, "tag_id")
        .groupBy("product_id")
        .agg(F.sort_array(F.collect_list("name")).alias("tags"))
    )


def priced_products(t: Tables) -> DataFrame:
    """Stored products with booleans and effective price, no joins."""
    return (t.products.withColumn("is_active", F.col("is_active").cast("boolean"))
            .withColumn("effective_price", pricing.effective_price(F.col("price"), F.col("sale_price")))
            .withColumn("is_discounted", pricing.is_discounted(F.col("price"), F.col("sale_price"))))


def denormalise(t: Tables, with_tags: bool = False) -> DataFrame:
    """Products with category and parent-category names, effective price, and booleans."""
    cat = t.categories.select("category_id", F.col("name").alias("category_name"), "parent_id")
    parent = t.categories.select(F.col("category_id").alias("parent_id"), F.col("name").alias("parent_category_name"))
    out = priced_products(t).join(cat, "category_id", "left").join(parent, "parent_id", "left").drop("parent_id")
    if with_tags:
        out = out.join(tag_arrays(t.product_tags, t.tags), "product_id", "left").withColumn(
            "tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out


def users(t: Tables) -> DataFrame:
    """Users with the name of their preferred category; a dangling id gives NULL."""
    cat = t.categories.select(F.col("category_id").alias("preferred_category_id"), F.col("name").alias("preferred_category"))
    return t.users.join(cat, "preferred_category_id", "left").select("user_id", "preferred_category", "age_group")


def purchases(events: DataFrame) -> DataFrame:
    return events.where("action_type = 'PURCHASE'")


def popularity(events: DataFrame) -> DataFrame:
    """Purchase rows and distinct purchasers per product. Rows are first combined per (product, user),
    so a product holding a large share of the log is spread over its users before the final sum."""
    per_user = purchases(events).groupBy("product_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("product_id").agg(
        F.sum("n").alias("purchase_count"), F.count(F.lit(1)).alias("distinct_purchasers"))


def cart_adds(events: DataFrame) -> DataFrame:
    return events.where("action_type = 'ADD_TO_CART'").groupBy("product_id").agg(F.count(F.lit(1)).alias("cart_add_count"))


def review_stats(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_id").agg(F.avg("rating").alias("average_rating"), F.count(F.lit(1)).alias("review_count"))


def price_context(catalog: DataFrame) -> DataFrame:
    """One row: tertile bounds, median, deviation of effective price and the largest list price;
    an empty catalog gives zeros (and maximum 1)."""
    pct = F.percentile("effective_price", F.array(F.lit(1 / 3), F.lit(0.5), F.lit(2 / 3)))
    row = catalog.agg(pct.alias("p"), F.stddev_pop("effective_price").alias("std_price"), F.max("price").alias("max_price"))
    zero = F.lit(0.0)
    return row.select(
        F.coalesce(F.col("p")[0], zero).alias("tier_lower"), F.coalesce(F.col("p")[2], zero).alias("tier_upper"),
        F.coalesce(F.col("p")[1], zero).alias("median_price"), F.coalesce("std_price", zero).alias("std_price"),
        F.coalesce("max_price", F.lit(1.0)).alias("max_price"),
    )


def category_prices(catalog: DataFrame) -> DataFrame:
    return catalog.where("category_name IS NOT NULL").groupBy("category_name").agg(
        F.median("effective_price").alias("category_median"), F.stddev_pop("effective_price").alias("category_std"))


def price_statistics(catalog: DataFrame) -> DataFrame:
    """Median and deviation for every category and for the whole catalog."""
    spread = catalog.groupingSets([["category_name"], []], "category_name").agg(
        F.grouping("category_name").alias("whole_catalog"), F.count(F.lit(1)).alias("products"), F.stddev_pop("effective_price").alias("std_price"),
    ).where("whole_catalog = 1 OR category_name IS NOT NULL")
    named = catalog.where("category_name IS NOT NULL")
    by_category = quantiles(named, ["category_name"], "effective_price", [0.5]).select("category_name", F.lit(0).alias("whole"), F.col("p")[0].alias("median_price"))
    everything = quantiles(catalog, [], "effective_price", [0.5]).select(F.lit(None).cast("string").alias("category_name"), F.lit(1).alias("whole"), F.col("p")[0].alias("median_price"))
    medians = by_category.union(everything).withColumnRenamed("category_name", "of")
    return spread.join(medians, F.col("category_name").eqNullSafe(F.col("of")) & (F.col("whole_catalog") == F.col("whole")), "left").drop("of", "whole")


def category_relative_price(catalog: DataFrame) -> DataFrame:
    """Share of same-category prices at or below each price; 0.5 alone in a category. The running
    count goes over distinct prices, so the window stays small however large the category is."""
    counts = catalog.where("category_name IS NOT NULL").groupBy("category_name", "effective_price").agg(F.count(F.lit(1)).alias("n"))
    by_price = W.partitionBy("category_name").orderBy("effective_price")
    whole = W.partitionBy("category_name")
    shares = counts.select(
        "category_name", "effective_price",
        F.sum("n").over(by_price).alias("upto"), F.sum("n").over(whole).alias("total"),
    ).select("category_name", "effective_price",
             F.when(F.col("total") == 1, F.lit(0.5)).otherwise(F.col("upto") / F.col("total")).alias("category_relative_price"))
    return shares


def eligibility_rules(params: EligibilityParams) -> dict:
    rules = {}
    if params.require_active:
        rules["is_active"] = F.col("is_active")
    if params.require_in_stock:
        rules["in_stock"] = F.col("stock_quantity") > 0
    return rules


def eligible(params: EligibilityParams):
    """All rules hold; a NULL outcome counts as failed."""
    cond = F.lit(True)
    for rule in eligibility_rules(params).values():
        cond = cond & F.coalesce(rule, F.lit(False))
    return cond


def product_features(t: Tables, events: DataFrame | None, params: EligibilityParams = EligibilityParams()) -> DataFrame:
    """The product feature table. `events` carries the popularity window: the whole log, a log cut at
    some time, or None for no popularity at all."""
    catalog = denormalise(t)
    ctx = price_context(priced_products(t))
    out = catalog.join(category_relative_price(catalog), ["category_name", "effective_price"], "left")
    # a scalar subquery: the one row of statistics is computed once and inlined, no join
    stats = ctx.select(F.struct("tier_lower", "tier_upper", "max_price").alias("s")).scalar()
    out = out.withColumn("s", stats).select("*", "s.*").drop("s")
    out = out.withColumn("category_relative_price", F.coalesce("category_relative_price", F.lit(0.5)))
    out = out.withColumn("price_tier", pricing.price_tier(F.col("effective_price"), F.col("tier_lower"), F.col("tier_upper")))
    if events is not None:
        out = (out.join(popularity(events), "product_id", "left")
               .join(cart_adds(events), "product_id", "left")
               .join(review_stats(t.reviews), "product_id", "left"))
    else:
        for name in ("purchase_count", "distinct_purchasers", "cart_add_count", "review_count"):
            out = out.withColumn(name, F.lit(0).cast("bigint"))
        out = out.withColumn("average_rating", F.lit(None).cast("double"))
    zero = F.lit(0).cast("bigint")
    return out.select(
        "product_id", "category_id", "category_name", "parent_category_name", "name", "brand", "price", "effective_price",
        F.coalesce("discount_percentage", F.lit(0.0)).alias("discount_percentage"), "is_active", "stock_quantity", "is_discounted",
        "price_tier", "category_relative_price",
        F.coalesce("purchase_count", zero).alias("purchase_count"), F.coalesce("distinct_purchasers", zero).alias("distinct_purchasers"),
        F.coalesce("cart_add_count", zero).alias("cart_add_count"), F.coalesce("review_count", zero).alias("review_count"),
        "average_rating", "max_price", eligible(params).alias("eligible"),
    )
