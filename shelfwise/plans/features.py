"""Feature plan: product features and one feature row per example, for everyone at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import affinity, catalog, history
from shelfwise.params import DEFAULTS, FeatureParams, Params
from shelfwise.sources.bindings import EMBEDDING_DIM, Tables
from shelfwise.sources.stage import stage


@dataclass(frozen=True)
class Catalog:
    """Staged catalog-side tables shared by every example."""
    features: DataFrame
    context: DataFrame
    category_prices: DataFrame
    users: DataFrame


def build_catalog(t: Tables, params: Params = DEFAULTS, events: DataFrame | None = None, popularity: bool = True) -> Catalog:
    """`events` limits popularity to a part of the log (default: all of it); `popularity=False` leaves it out."""
    log = (events if events is not None else t.events) if popularity else None
    features = stage(catalog.product_features(t, log, params.eligibility), "product_features")
    return Catalog(features, catalog.price_context(features), catalog.category_prices(features), catalog.users(t))


def live_examples(users: DataFrame) -> DataFrame:
    return users.select(F.col("user_id").alias("example_id"), "user_id")


def assemble(examples: DataFrame, counts: DataFrame, by_category: DataFrame, by_brand: DataFrame, vector: DataFrame, summary: DataFrame,
             cat: Catalog) -> DataFrame:
    """One row per example from its parts; missing parts become empty maps and NULL vectors. Affinities are (example_id, top)."""
    price = affinity.price_profiles(summary, examples, cat.users, cat.features, cat.context, cat.category_prices).drop("user_id")
    empty = F.create_map().cast("map<string,double>")
    categories = by_category.select("example_id", F.map_from_entries("top").alias("category_affinity"), F.try_element_at("top", F.lit(1))["name"].alias("top_category"))
    brands = by_brand.select("example_id", F.map_from_entries("top").alias("brand_affinity"))
    return (
        counts.join(cat.users, "user_id", "left")
        .join(categories, "example_id", "left")
        .join(brands, "example_id", "left")
        .join(vector, "example_id", "left")
        .join(price, "example_id", "left")
        .withColumn("category_affinity", F.coalesce("category_affinity", empty))
        .withColumn("brand_affinity", F.coalesce("brand_affinity", empty))
    )


def user_features(hist: DataFrame, examples: DataFrame, cat: Catalog, embeddings: DataFrame, params: FeatureParams,
                  dim: int = EMBEDDING_DIM) -> DataFrame:
    """Features per example from a history table. `hist` should be staged; it feeds five aggregations."""
    return assemble(
        examples, history.engagement_counts(hist, examples),
        affinity.as_lists(affinity.category_affinity(hist, cat.features, examples, cat.users, params)),
        affinity.as_lists(affinity.brand_affinity(hist, cat.features, params)),
        affinity.user_vectors(affinity.signal_vectors(hist, embeddings, params, dim), dim),
        affinity.price_summary(affinity.purchase_prices(hist, cat.features)), cat)


def latest_time(events: DataFrame) -> Column:
    """The log's last timestamp as a scalar subquery."""
    return events.agg(F.max("action_time").alias("now")).scalar()


def live_user_features(t: Tables, cat: Catalog, params: Params = DEFAULTS, as_of: Column | None = None,
                       events: DataFrame | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """Features of every user at `as_of` (default: the log's last timestamp), from `events` and `embeddings` (default: all)."""
    log = events if events is not None else t.events
    reference = as_of if as_of is not None else latest_time(log)
    hist = stage(history.live_history(history.signals(log), params.features.recency, reference), "live_history")
    return user_features(hist, live_examples(cat.users), cat, embeddings if embeddings is not None else t.embeddings, params.features)
