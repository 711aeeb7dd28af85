"""Training and evaluation examples of both protocols, with complete feature rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import affinity, history, loo, prefixes, temporal, temporal_examples
from shelfwise.params import DEFAULTS, Params
from shelfwise.plans.features import Catalog, assemble
from shelfwise.sources.bindings import EMBEDDING_DIM, Tables
from shelfwise.sources.stage import stage


@dataclass(frozen=True)
class LeaveOneOut:
    roles: DataFrame        # user_id, product_id, role
    held: DataFrame         # user_id, product_id of val and test
    examples: DataFrame     # example_id, user_id, product_id, kind
    counts: DataFrame       # user_id, signal, product_id, n
    mentions: DataFrame     # unresolved searches naming purchased products: user_id, text_id, product_id
    usable: DataFrame       # example_id, chat_ok
    open_searches: DataFrame
    summaries: DataFrame


def leave_one_out(t: Tables, params: Params = DEFAULTS) -> LeaveOneOut:
    sig = history.signals(t.events)
    searches = t.searches
    counts = stage(loo.signal_counts(sig, searches), "loo_counts")
    pairs = counts.where("signal = 'purchase'").select("user_id", "product_id")
    roles = stage(loo.splits(pairs, params.min_distinct_products_for_holdout, params.split_seed), "loo_roles")
    held = roles.where("role <> 'train'").select("user_id", "product_id")
    ex = loo.examples(roles)
    names = pairs.join(t.products.select("product_id", "name"), "product_id")
    open_searches = searches.where("matched_product_id IS NULL AND search_term IS NOT NULL").select("user_id", F.col("event_id").alias("text_id"), F.col("search_term").alias("text"))
    mentions = stage(loo.text_mentions(open_searches, names), "loo_mentions")
    summaries = t.chatbot.where("summary IS NOT NULL").select("user_id", F.col("summary").alias("text"))
    in_summary = loo.text_mentions(summaries.withColumn("text_id", F.lit(0)), names)
    flags = loo.chatbot_flags(counts, in_summary, pairs)
    usable = stage(loo.chatbot_usable(ex, flags, held), "loo_usable")
    return LeaveOneOut(roles, held, ex, counts, mentions, usable, open_searches, summaries)


def loo_categories(l: LeaveOneOut, cat: Catalog, params: Params = DEFAULTS) -> DataFrame:
    p = params.features
    bonus = cat.users.where("preferred_category IS NOT NULL").select("user_id", F.col("preferred_category").alias("name"), F.lit(p.preferred_category_weight).alias("bonus"))
    return loo.top_attributes(l.counts, l.held, l.examples, l.usable, cat.features, "category_name", p, p.max_top_categories, bonus)


def loo_features(t: Tables, l: LeaveOneOut, cat: Catalog, params: Params = DEFAULTS, text_vectors: DataFrame | None = None) -> DataFrame:
    p = params.features
    by_brand = loo.top_attributes(l.counts, l.held, l.examples, l.usable, cat.features, "brand", p, p.max_top_brands)
    vector = loo.user_vectors(l.counts, l.held, l.examples, l.usable, t.embeddings, p, EMBEDDING_DIM, l.open_searches, l.mentions, l.summaries, text_vectors)
    centre = cat.context.select("median_price").scalar()
    counts = loo.example_counts(l.counts, t.searches, l.counts.where("signal = 'chatbot'"), l.held, l.examples)
    return assemble(l.examples, counts, loo_categories(l, cat, params), by_brand, vector,
                    loo.price_sums(l.counts, l.held, l.examples, cat.features, centre), cat)


@dataclass(frozen=True)
class TemporalExamples:
    examples: DataFrame   # example_id, user_id, product_id, cutoff, at
    log: DataFrame        # weighted signals
    base: DataFrame       # running counts and price sums per example
    hot: DataFrame        # users whose log is cut into days


def temporal_training(t: Tables, split: DataFrame, cat: Catalog, params: Params = DEFAULTS) -> TemporalExamples:
    sig = history.signals(t.events)
    recency = params.features.recency
    ex = temporal_examples.training_examples(temporal.timed_purchases(t.events), split)
    ex = stage(temporal_examples.example_weights(ex, sig, recency), "train_examples")
    log = stage(temporal_examples.weighted_log(sig, recency), "weighted_log")
    centre = cat.context.select("median_price").scalar()
    base = stage(temporal_examples.base_totals(log, ex, cat.features, centre), "train_totals")
    return TemporalExamples(ex, log, base, prefixes.hot_users(log))


def temporal_category_contributions(te: TemporalExamples, cat: Catalog, params: Params = DEFAULTS) -> DataFrame:
    chat = temporal_examples.chatbot_factors(te.base, te.examples, params.features.recency)
    parts = prefixes.attribute_contributions(te.log, te.examples, chat, cat.features, "category_name", params.features, hot=te.hot)
    return parts.unionByName(affinity.preferred_bonus(te.examples, cat.users, params.features)).groupBy("example_id", "name").agg(F.sum("v").alias("v"))


def temporal_features(t: Tables, te: TemporalExamples, cat: Catalog, params: Params = DEFAULTS) -> DataFrame:
    p = params.features
    chat = temporal_examples.chatbot_factors(te.base, te.examples, p.recency)
    by_cat = affinity.top_normalised(temporal_category_contributions(te, cat, params), p.max_top_categories)
    by_brand = affinity.top_normalised(prefixes.attribute_contributions(te.log, te.examples, chat, cat.features, "brand", p, p.max_top_brands, hot=te.hot), p.max_top_brands)
    vector = prefixes.user_vectors(te.log, te.examples, chat, t.embeddings, p, EMBEDDING_DIM, hot=te.hot)
    centre = cat.context.select("median_price").scalar()
    return assemble(te.examples, temporal_examples.counts(te.base), affinity.as_lists(by_cat), affinity.as_lists(by_brand), vector,
                    temporal_examples.price_summary(te.base, centre), cat)
