"""Category and brand affinities, user vectors and price profiles from the history table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions import pricing, vectors
from shelfwise.params import SIGNALS, FeatureParams


def base_weight(params: FeatureParams) -> Column:
    expr = F.lit(0.0)
    for signal in SIGNALS:
        expr = F.when(F.col("signal") == signal, F.lit(params.weight(signal))).otherwise(expr)
    return expr


def contributions(hist: DataFrame, catalog: DataFrame, attribute: str, params: FeatureParams) -> DataFrame:
    """Signal weight x decay summed per (example, attribute value); unknown products drop out. A `qty`
    column (decayed quantities) replaces `w` for purchases and carts where the source has quantities."""
    weight = F.col("w")
    if "qty" in hist.columns:
        weight = F.when(F.col("signal").isin("purchase", "cart"), F.col("qty")).otherwise(F.col("w"))
    attrs = catalog.select("product_id", F.col(attribute).alias("name")).where("name IS NOT NULL AND name <> ''")
    return hist.join(attrs, "product_id").groupBy("example_id", "name").agg(F.sum(base_weight(params) * weight).alias("v"))


def preferred_bonus(examples: DataFrame, users: DataFrame, params: FeatureParams) -> DataFrame:
    """The standing preference of a user: never decayed."""
    return examples.select("example_id", "user_id").join(users.where("preferred_category IS NOT NULL"), "user_id").select(
        "example_id", F.col("preferred_category").alias("name"), F.lit(params.preferred_category_weight).alias("v"))


def top_normalised(contrib: DataFrame, k: int) -> DataFrame:
    """Keep the k largest per example, then normalise over the kept ones. Ties go by name; sums are
    compared at 12 digits so that their order of addition cannot decide."""
    order = W.partitionBy("example_id").orderBy(F.round("v", 12).desc(), F.col("name"))
    kept = contrib.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    total = F.sum("v").over(W.partitionBy("example_id"))
    return kept.withColumn("total", total).where("total > 0").select(
        "example_id", "name", (F.col("v") / F.col("total")).alias("weight"), "rank")


def category_affinity(hist: DataFrame, catalog: DataFrame, examples: DataFrame, users: DataFrame, params: FeatureParams,
                      extra: DataFrame | None = None) -> DataFrame:
    """`extra` adds (example_id, name, v) rows, e.g. the category a chatbot record states itself."""
    parts = contributions(hist, catalog, "category_name", params).unionByName(preferred_bonus(examples, users, params))
    if extra is not None:
        parts = parts.unionByName(extra)
    return top_normalised(parts.groupBy("example_id", "name").agg(F.sum("v").alias("v")), params.max_top_categories)


def brand_affinity(hist: DataFrame, catalog: DataFrame, params: FeatureParams) -> DataFrame:
    return top_normalised(contributions(hist, catalog, "brand", params), params.max_top_brands)


def top_category(affinity: DataFrame) -> DataFrame:
    return affinity.where("rank = 1").select("example_id", F.col("name").alias("top_category"))


def as_lists(affinity: DataFrame) -> DataFrame:
    """(example_id, top): affinity rows folded into one array of (name, weight) per example, by rank (at most k entries)."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "name", "weight")))
    return affinity.groupBy("example_id").agg(ranked.alias("r")).select(
        "example_id", F.transform("r", lambda e: F.struct(e["name"].alias("name"), e["weight"].alias("weight"))).alias("top"))


def as_rows(lists: DataFrame) -> DataFrame:
    """(example_id, name, weight, rank) of (example_id, top)."""
    return lists.select("example_id", F.posexplode("top").alias("pos", "e")).select("example_id", "e.name", "e.weight", (F.col("pos") + 1).alias("rank"))


def signal_vectors(hist: DataFrame, embeddings: DataFrame, params: FeatureParams, dim: int) -> DataFrame:
    """Per (example, signal): the decay-weighted mean vector, and base weight x mean decay as its blend weight."""
    # the floor keeps a plain mean where every decay factor has underflowed
    rows = hist.join(vectors.checked(embeddings, "embedding", dim), "product_id").withColumn("fw", F.greatest(F.col("w"), F.col("n") * F.lit(1e-300)))
    agg = rows.groupBy("example_id", "signal").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("fw").alias("fw"), vectors.weighted_sum("embedding", "fw", dim).alias("wv"))
    return blend_components(agg, params)


def blend_components(agg: DataFrame, params: FeatureParams) -> DataFrame:
    return agg.select("example_id", "signal", vectors.scale(F.col("wv"), 1 / F.col("fw")).alias("vector"),
                      (base_weight(params) * F.col("w") / F.col("n")).alias("blend_weight"))


def user_vectors(components: DataFrame, dim: int) -> DataFrame:
    """Weighted average over the signals an example really has."""
    agg = components.where("blend_weight > 0").groupBy("example_id").agg(
        F.sum("blend_weight").alias("total"),
        vectors.weighted_sum("vector", "blend_weight", dim).alias("s"))
    return agg.select("example_id", vectors.scale(F.col("s"), 1 / F.col("total")).alias("vector"))


def purchase_prices(hist: DataFrame, catalog: DataFrame) -> DataFrame:
    """Price of each purchase row: its own unit price where the source has one, else the product's
    effective price; rows without either drop out."""
    bought = hist.where("signal = 'purchase'").join(catalog.select("product_id", "effective_price"), "product_id", "left")
    own = F.col("unit_price") if "unit_price" in hist.columns else F.lit(None).cast("double")
    return bought.withColumn("paid", F.coalesce(own, F.col("effective_price"))).where("paid IS NOT NULL")


def price_summary(paid: DataFrame) -> DataFrame:
    """Decay-weighted mean, population deviation and count per example, from (n, w, paid) rows."""
    agg = paid.groupBy("example_id").agg(
        F.sum("n").alias("cnt"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("paid")).alias("swp"),
        F.sum(F.col("n") * F.col("paid")).alias("sp"), F.sum(F.col("n") * F.col("paid") * F.col("paid")).alias("spp"),
        F.min("paid").alias("lo"), F.max("paid").alias("hi"))
    return finish_price_summary(agg)


def finish_price_summary(agg: DataFrame) -> DataFrame:
    mean = F.col("sp") / F.col("cnt")
    spread = F.when(F.col("lo") == F.col("hi"), F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.col("spp") / F.col("cnt") - mean * mean, F.lit(0.0))))
    return agg.select("example_id", F.when(F.col("sw") > 0, F.col("swp") / F.col("sw")).otherwise(mean).alias("own_typical"),
                      spread.alias("own_spread"), F.col("cnt").cast("bigint").alias("own_count"))


def price_profiles(summary: DataFrame, examples: DataFrame, users: DataFrame, catalog: DataFrame, context: DataFrame,
                   category_prices: DataFrame) -> DataFrame:
    """Own purchases, else the preferred category's median, else the catalog median."""
    pref = users.select("user_id", "preferred_category")
    stats = context.select(F.struct("tier_lower", "tier_upper", "median_price", "std_price").alias("s")).scalar()
    out = (
        examples.select("example_id", "user_id").join(pref, "user_id", "left")
        .join(category_prices, F.col("preferred_category") == F.col("category_name"), "left")
        .join(summary, "example_id", "left")
        .withColumn("s", stats)
    )
    own, prior = F.col("own_count").isNotNull(), F.col("category_median").isNotNull()
    out = out.select(
        "example_id", "user_id",
        F.when(own, F.col("own_typical")).when(prior, F.col("category_median")).otherwise(F.col("s.median_price")).alias("typical_price"),
        F.when(own, F.col("own_spread")).when(prior, F.col("category_std")).otherwise(F.col("s.std_price")).alias("price_spread"),
        F.coalesce("own_count", F.lit(0).cast("bigint")).alias("supporting_purchase_count"),
        F.when(own, "purchase_history").when(prior, "preferred_category_prior").otherwise("catalog_prior").alias("fallback_source"),
        "s",
    )
    return out.withColumn("price_tier", pricing.price_tier(F.col("typical_price"), F.col("s.tier_lower"), F.col("s.tier_upper"))).drop("s")
