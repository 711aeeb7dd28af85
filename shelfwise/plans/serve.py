"""Batch recommendations for every user (or evaluation case) in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.operators import candidates as cand
from shelfwise.operators import eligibility, quality, rerank, retrieval
from shelfwise.params import DEFAULTS, Params
from shelfwise.plans.features import Catalog
from shelfwise.sources.stage import stage

#: Parts into which the users of one group are split where they meet the group's list.
_PARTS = 32
_LISTS = ("example_id", "position", "product_id", "score", "source")


@dataclass(frozen=True)
class Recommendations:
    items: DataFrame      # example_id, rank, product_id, score, source
    meta: DataFrame       # example_id, user_id, tier and counters
    pool: DataFrame       # candidate lists before re-ranking: example_id, position, product_id, score, source
    reranked: DataFrame   # after re-ranking, before the final check


def personalised(features: DataFrame, cat: Catalog, embeddings: DataFrame, pool: int, params: Params,
                 scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Retrieved eligible products per example, in retrieval order or in the order of `scorer`, which maps
    (query_id, item_id, score, rank) rows to the same rows with a `model_score`."""
    queries = features.where("vector IS NOT NULL").select(F.col("example_id").alias("query_id"), "vector")
    allowed = cat.features.where("eligible").select(F.col("product_id").alias("item_id"))
    items = embeddings.select(F.col("product_id").alias("item_id"), F.col("embedding").alias("vector"))
    hits = retrieval.nearest_items(queries, items, pool, params.retrieval, allowed=allowed)
    if scorer is None:
        return hits.select(F.col("query_id").alias("example_id"), F.col("rank").alias("position"), F.col("item_id").alias("product_id"),
                           "score", F.lit("personalized").alias("source"))
    from shelfwise.operators.ranking import order_by_model
    ranked = order_by_model(scorer(hits))
    return ranked.select(F.col("query_id").alias("example_id"), "position", F.col("item_id").alias("product_id"),
                         F.col("model_score").alias("score"), F.lit("personalized").alias("source"))


def _with_list(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Every row with every entry of a popularity list of at most `pool` products, carried as one array value."""
    entries = top.agg(F.collect_list(F.struct("product_id", "rank", "list_size")).alias("l")).scalar()
    return rows.withColumn("_entry", F.explode(entries)).select(*rows.columns, "_entry.*")


def _sparse_pool(sparse: DataFrame, own: DataFrame, top_global: DataFrame, top_category: DataFrame, global_cat_rank: DataFrame,
                 pool: int, params: Params) -> DataFrame:
    c = params.cold_start
    size = own.groupBy("example_id").agg(F.count(F.lit(1)).alias("list_size"))
    mine = own.join(size, "example_id").select("example_id", F.lit(0).alias("source_order"), F.lit("personalized").alias("source"),
                                              F.lit(c.blend_personalized).alias("weight"), "product_id", F.col("position").alias("rank"), "list_size")
    users = sparse.select("example_id", "preferred_category")
    # products of the global list also count in the preferred list, at their true rank there
    preferred_rows = top_category.unionByName(global_cat_rank.select("category_name", "product_id", "rank", "list_size")).distinct()
    preferred = users.join(preferred_rows, F.col("preferred_category") == F.col("category_name")).select(
        "example_id", F.lit(1).alias("source_order"), F.lit("preferred_category").alias("source"), F.lit(c.blend_preferred_category).alias("weight"),
        "product_id", "rank", "list_size")
    popular = _with_list(users, top_global).select(
        "example_id", F.lit(2).alias("source_order"), F.lit("popularity").alias("source"), F.lit(c.blend_popularity).alias("weight"),
        "product_id", "rank", "list_size")
    return cand.blend(mine.unionByName(preferred).unionByName(popular), "example_id", pool)


def _fallback_pools(groups: DataFrame, top_global: DataFrame, top_category: DataFrame, pool: int, params: Params) -> DataFrame:
    """Waterfall lists per group of users that share preferred and top category."""
    order = {name: i for i, name in enumerate(params.cold_start.no_history_fallback_order)}
    parts = []
    for name, column in (("preferred_category", "preferred_category"), ("category_popularity", "top_category")):
        if name in order:
            parts.append(groups.join(top_category, F.col(column) == F.col("category_name")).select(
                "group_id", F.lit(order[name]).alias("source_order"), F.lit(name).alias("source"), "product_id", "rank", "list_size"))
    if "global_popularity" in order:
        parts.append(_with_list(groups, top_global).select(
            "group_id", F.lit(order["global_popularity"]).alias("source_order"), F.lit("global_popularity").alias("source"), "product_id", "rank", "list_size"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return cand.waterfall(rows, "group_id", pool)


def _to_members(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Every member with the rows of its group. One group may hold most of the users, so groups are joined in parts; lists are
    at most one pool long, and only they are repeated."""
    part = F.pmod(F.xxhash64("example_id"), F.lit(_PARTS)).cast("int")
    copies = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    return members.withColumn("_part", part).join(copies, ["group_id", "_part"]).drop("_part")


def recommend(features: DataFrame, cat: Catalog, embeddings: DataFrame, params: Params = DEFAULTS, top_n: int | None = None,
              scorer: Callable[[DataFrame], DataFrame] | None = None, final_catalog: DataFrame | None = None, dim: int | None = None) -> Recommendations:
    """Tier by history, candidates per tier, diversity re-ranking, final eligibility check, top N.

    Vectors and user rows that are not fit for serving are refused with `quality.UnfitTable` before anything is ranked.

    `features` (one row per example) should be staged. Users without history, and those with a long one for whom nothing
    is retrieved, get one common list per pair of categories, built and re-ranked once and joined back at the end."""
    top_n = top_n or params.top_n
    quality.require_vectors(embeddings, cat.features, dim)
    quality.require_profiles(features, embeddings, dim)
    eligible = cat.features.where("eligible")
    n_eligible, n_catalog = eligible.count(), cat.features.count()
    feats = features.withColumn("tier", cand.history_tier(F.col("total_engagement_events"), params.cold_start))
    if n_eligible == 0:
        empty = features.sparkSession.createDataFrame([], "example_id bigint, position bigint, product_id bigint, score double, source string")
        none = empty.withColumnRenamed("position", "rank")
        return Recommendations(none, _meta(feats, none, 0, n_catalog, 0, top_n), empty, none)
    pool = retrieval.pool_size(params.retrieval, top_n, n_eligible)

    top_global = cand.global_top(eligible, pool)
    top_category = cand.category_top(eligible, pool)
    lists = stage(top_global, "global_top"), stage(top_category, "category_top")
    global_cat_rank = cand.category_rank_of(lists[0], eligible)

    active = feats.where("tier <> 'no_history'")
    own = personalised(active, cat, embeddings, pool, params, scorer)
    tiers = feats.select("example_id", "tier", "preferred_category")
    own = stage(own, "personalised")
    strong = own.join(tiers.where("tier = 'strong'"), "example_id", "left_semi").select(*_LISTS)
    sparse_users = tiers.where("tier = 'sparse'")
    sparse = _sparse_pool(sparse_users, own.join(sparse_users, "example_id", "left_semi"), *lists, global_cat_rank, pool, params).select(*_LISTS)

    # Users with a long history but nothing retrieved (no vector, or none near it) get the shared lists too.
    unanswered = feats.where("tier = 'strong'").join(own.select("example_id").distinct(), "example_id", "left_anti")
    idle = feats.where("tier = 'no_history'").unionByName(unanswered).select("example_id", "preferred_category", "top_category")
    # A group is named by its two categories; NULL is a value of its own.
    idle = idle.withColumn("group_id", F.to_json(F.array("preferred_category", "top_category")))
    groups = stage(idle.select("group_id", "preferred_category", "top_category").distinct(), "groups")
    idle = idle.select("example_id", "group_id")
    fallback = _fallback_pools(groups, *lists, pool, params)

    attrs = cat.features.select("product_id", "category_name", "brand")
    own_pool = strong.unionByName(sparse)
    ranked_own = rerank.rerank(own_pool.join(attrs, "product_id", "left"), "example_id", params.reranking)
    ranked_shared = rerank.rerank(fallback.join(attrs, "product_id", "left"), "group_id", params.reranking)
    members = idle
    current = final_catalog if final_catalog is not None else cat.features
    checked_own = _final_check(ranked_own, "example_id", current, params, top_n)
    checked_shared = _final_check(ranked_shared, "group_id", current, params, top_n)
    keep = ["example_id", "rank", "product_id", "score", "source"]
    items = checked_own.where("final_rank <= %d" % top_n).select("example_id", F.col("final_rank").alias("rank"), *keep[2:]).unionByName(
        _to_members(members, checked_shared.where("final_rank <= %d" % top_n)).select("example_id", F.col("final_rank").alias("rank"), *keep[2:]))
    reranked = ranked_own.select(*keep).unionByName(_to_members(members, ranked_shared).select(*keep))
    pools = own_pool.unionByName(_to_members(members, fallback).select(*_LISTS))

    before_own = ranked_own.groupBy("example_id").agg(F.count(F.lit(1)).alias("num_before_eligibility"))
    kept_own = checked_own.groupBy("example_id").agg(F.count(F.lit(1)).alias("kept"))
    before_shared = ranked_shared.groupBy("group_id").agg(F.count(F.lit(1)).alias("num_before_eligibility"))
    kept_shared = checked_shared.groupBy("group_id").agg(F.count(F.lit(1)).alias("kept"))
    sizes = before_own.join(kept_own, "example_id", "left").unionByName(
        _to_members(members, before_shared.join(kept_shared, "group_id", "left")).drop("group_id"))
    return Recommendations(items, _meta(feats, sizes, pool, n_catalog, n_eligible, top_n), pools, reranked)


def _final_check(ranked: DataFrame, key: str, current: DataFrame, params: Params, top_n: int) -> DataFrame:
    """The same rules against the current catalog state; the surviving rows are renumbered."""
    ok = eligibility.apply_rules(ranked, "product_id", current, params.eligibility).where("eligible").drop("reasons", "eligible")
    return ok.withColumn("final_rank", F.row_number().over(W.partitionBy(key).orderBy("rank")).cast("bigint"))


def _meta(feats: DataFrame, sizes: DataFrame, pool: int, n_catalog: int, n_eligible: int, top_n: int) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    base = feats.select("example_id", "user_id", "tier")
    if pool == 0:
        base = base.withColumn("num_before_eligibility", zero).withColumn("kept", zero)
    else:
        base = base.join(sizes, "example_id", "left")
    before, kept = F.coalesce("num_before_eligibility", zero), F.coalesce("kept", zero)
    returned = F.least(kept, F.lit(top_n).cast("bigint"))
    return base.select(
        "example_id", "user_id", "tier", F.lit(top_n).cast("bigint").alias("requested_n"), F.lit(pool).cast("bigint").alias("pool_size"),
        F.lit(n_catalog - n_eligible).cast("bigint").alias("num_excluded_pre_retrieval"), before.alias("num_before_eligibility"),
        (before - kept).alias("num_excluded_by_eligibility"), returned.alias("returned"), (returned / top_n).alias("fill_rate"))


def unknown_users(requested: DataFrame, users: DataFrame) -> DataFrame:
    """Requested ids without a user row; a known user without history is not one of them."""
    return requested.join(users.select("user_id"), "user_id", "left_anti")


def display_rows(items: DataFrame, products: DataFrame) -> DataFrame:
    """Recommendations with the catalog columns shown to people; scores rounded to 4 digits."""
    cols = products.select("product_id", "name", F.col("category_name").alias("category"), "brand", "price", "is_active", "stock_quantity")
    return items.join(cols, "product_id", "left").select(
        "example_id", "rank", "product_id", F.round("score", 4).alias("score"), "source", F.coalesce("name", F.lit("(unknown product)")).alias("name"),
        "category", "brand", "price", "is_active", "stock_quantity")
