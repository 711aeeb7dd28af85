"""Data-quality jobs: foreign keys, cross-table consistency, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.vectors import is_finite
from shelfwise.operators.catalog import purchases
from shelfwise.operators.scan import quantiles
from shelfwise.sources.bindings import COUNTED_ORDER_STATUSES, Tables


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def dangling(rows: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of a foreign key without parent row, with the number of rows using each. Keys are grouped before
    the anti join, so it moves distinct values, not rows."""
    used = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(parent.select(F.col(key).alias("value")), "value", "left_anti")


def references(t: Tables) -> list[tuple[DataFrame, dict[str, tuple[Column, str]]]]:
    """Per child table its checks: name, column of ids (NULL where the check does not apply), parent table."""
    c, at = F.col, lambda action, column: F.when(F.col("action_type") == action, F.col(column))
    return [
        (t.categories, {"category.parent_id": (c("parent_id"), "category")}),
        (t.products, {"product.category_id": (c("category_id"), "category")}),
        (t.product_tags, {"product_tag.product_id": (c("product_id"), "product"), "product_tag.tag_id": (c("tag_id"), "tag")}),
        (t.users, {"user.preferred_category_id": (c("preferred_category_id"), "category")}),
        (t.orders, {"order.user_id": (c("user_id"), "user")}),
        (t.order_items, {"order_item.order_id": (c("order_id"), "order"), "order_item.product_id": (c("product_id"), "product")}),
        (t.carts, {"cart.user_id": (c("user_id"), "user")}),
        (t.cart_items, {"cart_item.cart_id": (c("cart_id"), "cart"), "cart_item.product_id": (c("product_id"), "product")}),
        (t.reviews, {"review.user_id": (c("user_id"), "user"), "review.product_id": (c("product_id"), "product")}),
        (t.events, {"click.user_id": (at("CLICK", "user_id"), "user"), "click.product_id": (at("CLICK", "product_id"), "product"),
                    "chatbot.user_id": (at("CHATBOT", "user_id"), "user"), "chatbot.mentioned_product_id": (at("CHATBOT", "product_id"), "product")}),
        (t.searches, {"search.user_id": (c("user_id"), "user"), "search.matched_product_id": (c("matched_product_id"), "product")}),
    ]


def foreign_key_report(t: Tables) -> DataFrame:
    """Dangling values and rows per check; every check has a row.

    Each child table is read once, whatever the number of its checks, and each parent once: the ids of all checks are counted in
    one grouped count and meet the keys of all parents in one join. Only distinct ids are joined, on (parent, id), so neither a frequent
    id nor a large parent makes a hot key."""
    children = references(t)
    ids = union_all([df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.lit(parent).alias("parent"), column.cast("bigint").alias("value"))
                                                   for name, (column, parent) in checks.items()])).alias("s")).select("s.*") for df, checks in children])
    used = ids.where("value IS NOT NULL").groupBy("check", "parent", "value").agg(F.count(F.lit(1)).alias("rows"))
    parents = {"category": (t.categories, "category_id"), "product": (t.products, "product_id"), "tag": (t.tags, "tag_id"),
               "user": (t.users, "user_id"), "order": (t.orders, "order_id"), "cart": (t.carts, "cart_id")}
    keys = union_all([df.select(F.lit(name).alias("parent"), F.col(key).cast("bigint").alias("value")) for name, (df, key) in parents.items()]).distinct()
    # An anti join would be pushed below the union, once for each child table, with all parents read again for each.
    known = keys.withColumn("known", F.lit(True))
    lost = used.join(known, ["parent", "value"], "left").where("known IS NULL").select("check", F.lit(1).cast("bigint").alias("n"), "rows")
    zero = F.lit(0).cast("bigint")
    every = t.spark.range(1).select(F.explode(F.array(*[F.lit(name) for _, checks in children for name in checks])).alias("check"), zero.alias("n"), zero.alias("rows"))
    return lost.unionByName(every).groupBy("check").agg(F.sum("n").alias("dangling_values"), F.sum("rows").alias("dangling_rows"))


def pair_consistency(t: Tables) -> DataFrame:
    """(user, product) pairs that exist on one side only, per rule, with their row counts."""
    bought = purchases(t.events).groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("rows"))
    lines = t.order_items.join(t.orders, "order_id")
    all_lines = lines.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("rows"))
    counted = lines.where(F.col("status").isin(list(COUNTED_ORDER_STATUSES))).groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("rows"))
    reviewed = t.reviews.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("rows"))
    keys = ["user_id", "product_id"]
    rules = {"purchase_without_order_line": (bought, all_lines), "order_line_without_purchase": (counted, bought), "review_without_purchase": (reviewed, bought)}
    return union_all([a.join(b.select(*keys), keys, "left_anti").agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows")).select(
        F.lit(n).alias("rule"), "pairs", "rows") for n, (a, b) in rules.items()])


def null_counts(df: DataFrame, table: str) -> DataFrame:
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    packed = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]))
    return agg.select("rows", packed.alias("s")).select(F.lit(table).alias("table"), "s.column", "rows", "s.nulls")


def duplicate_keys(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Keys occurring more than once, and the rows involved."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows")).select(F.lit(table).alias("table"), "duplicate_keys", "rows")


def numeric_profile(df: DataFrame, column: str, name: str) -> DataFrame:
    """Range, mean and exact quantiles; no task holds the column's values."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    agg = values.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"))
    agg = agg.withColumn("p", quantiles(values, [], "x", [0.25, 0.5, 0.75, 0.95]).select("p").scalar())
    return agg.select(F.lit(name).alias("what"), F.when(F.col("n") > 0, F.col("n")).alias("rows"), "min", F.col("p")[0].alias("p25"), F.col("p")[1].alias("median"), "mean", F.col("p")[2].alias("p75"), F.col("p")[3].alias("p95"), "max")


def availability_cube(products: DataFrame) -> DataFrame:
    return products.select(F.col("is_active").alias("active"), (F.col("stock_quantity") > 0).alias("in_stock")).cube("active", "in_stock").agg(F.count(F.lit(1)).alias("products"))


def discount_consistency(products: DataFrame) -> DataFrame:
    sale = F.col("sale_price").isNotNull()
    derived = F.round((F.col("price") - F.col("sale_price")) / F.col("price") * 100, 1)
    return products.agg(F.count(F.when(sale, 1)).alias("on_sale"), F.count(F.when(F.col("sale_price") > F.col("price"), 1)).alias("sale_above_price"),
                        F.count(F.when(sale & (F.abs(F.col("discount_percentage") - derived) > 0.2), 1)).alias("percentage_off"))


def funnel_order(events: DataFrame) -> DataFrame:
    """Of the (user, product) pairs with both steps, how many took them in order."""
    first = events.groupBy("user_id", "product_id").agg(*[F.min(F.when(F.col("action_type") == a, F.col("action_time"))).alias(n) for a, n in (("CLICK", "click"), ("ADD_TO_CART", "cart"), ("PURCHASE", "purchase"))])
    return first.agg(F.count(F.when(F.col("cart").isNotNull() & F.col("purchase").isNotNull(), 1)).alias("cart_purchase_pairs"), F.count(F.when(F.col("cart") <= F.col("purchase"), 1)).alias("cart_before_purchase"),
                     F.count(F.when(F.col("click").isNotNull() & F.col("cart").isNotNull(), 1)).alias("click_cart_pairs"), F.count(F.when(F.col("click") <= F.col("cart"), 1)).alias("click_before_cart"))


def activity_depth(events: DataFrame) -> DataFrame:
    """Users with at least k distinct event times, purchase times, purchased products; repeated purchases."""
    times = events.groupBy("user_id", "action_time").agg(F.max((F.col("action_type") == "PURCHASE").cast("int")).alias("bought"))
    per_user = times.groupBy("user_id").agg(F.count("action_time").alias("t"), F.count(F.when(F.col("bought") == 1, F.col("action_time"))).alias("pt"))
    pairs = purchases(events).groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    prods = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("p"))

    def at_least(df, col, ks, name):
        agg = df.agg(*[F.count(F.when(F.col(col) >= k, 1)).alias(str(k)) for k in ks])
        return agg.select(F.explode(F.array(*[F.struct(F.lit(name).alias("what"), F.lit(k).cast("bigint").alias("k"), F.col(str(k)).alias("value")) for k in ks])).alias("s")).select("s.*")

    repeat = pairs.where("n > 1").agg(F.count(F.lit(1)).alias("value")).select(F.lit("repeat_purchase_pairs").alias("what"), F.lit(2).cast("bigint").alias("k"), "value")
    return union_all([at_least(per_user, "t", (2, 5, 10), "users_by_event_times"), at_least(per_user, "pt", (2, 3), "users_by_purchase_times"), at_least(prods, "p", (2, 3, 5), "users_by_products"), repeat])


def dataset_summary(t: Tables) -> DataFrame:
    """Sizes of the tables and shares of users. Users and events are read once: both are counted per user before they meet."""
    def n(df, name):
        return df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("what"), "value")

    incomplete = F.col("preferred_category_id").isNull() | F.col("age_group").isNull()
    known = t.users.groupBy("user_id").agg(F.count(F.lit(1)).alias("users"), F.count(F.when(incomplete, 1)).alias("incomplete"))
    did = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max(F.col("action_type") == "PURCHASE").alias("bought"), F.max(F.col("action_type") == "ADD_TO_CART").alias("in_cart"))
    one = known.join(did, "user_id", "full_outer").agg(
        F.coalesce(F.sum("users"), F.lit(0)).alias("users"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.sum("incomplete").alias("incomplete"),
        F.sum(F.when(F.col("bought"), F.col("users"))).alias("bought"), F.sum(F.when(F.col("in_cart"), F.col("users"))).alias("in_cart"))

    def share(column):
        return F.when(F.col("users") > 0, F.coalesce(column, F.lit(0)) / F.col("users"))

    values = {"users": F.col("users"), "events": F.col("events"), "share_users_with_purchases": share("bought"), "share_users_with_carts": share("in_cart"),
              "share_incomplete_profiles": share("incomplete")}
    per_user = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.cast("double").alias("value")) for k, v in values.items()])).alias("s")).select("s.*")
    return union_all([n(t.products, "products"), n(t.categories, "categories"), n(t.tags, "tags"), n(t.orders, "orders"), n(t.order_items, "order_items"), n(t.reviews, "reviews"), per_user])


def _wrong_size(vector: Column, dim: int | None, longest: Column) -> Column:
    return F.size(vector) != (longest if dim is None else F.lit(dim))


def embedding_checks(embeddings: DataFrame, products: DataFrame, dim: int | None) -> DataFrame:
    """One row per check of the embedding table against the catalog; every problem count should be 0. Both tables are read
    once; without `dim`, a pass over the lengths before that takes the longest vector's as the right one."""
    v = F.col("embedding")
    rules = {"empty": v.isNull() | (F.size(v) == 0), "wrong_dim": _wrong_size(v, dim, longest(embeddings)), "not_finite": ~is_finite(v)}
    stored = embeddings.groupBy("product_id").agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(rule, 1)).alias(name) for name, rule in rules.items()])
    listed = products.groupBy("product_id").agg(F.count(F.lit(1)).alias("listed"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = stored.join(listed, "product_id", "full_outer").agg(
        *[total(c).alias(c) for c in ("rows", *rules)], total(F.when(F.col("listed").isNull(), F.col("rows"))).alias("ids_not_in_catalog"),
        total(F.when(F.col("rows").isNull(), F.col("listed"))).alias("catalog_without_vector"), F.count(F.when(F.col("rows") > 1, 1)).alias("duplicate_ids"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("value")) for c in one.columns])).alias("s")).select("s.*")


class UnfitTable(ValueError):
    """A table that serving must not use."""


#: Checks of the vectors that no serving job accepts, and those of equal id sets, which a caller may ask for.
VECTOR_CHECKS = ("empty", "wrong_dim", "not_finite", "duplicate_ids")
ID_CHECKS = ("ids_not_in_catalog", "catalog_without_vector")


def longest(embeddings: DataFrame) -> Column:
    return embeddings.agg(F.max(F.size("embedding"))).scalar()


def require_vectors(embeddings: DataFrame, products: DataFrame, dim: int | None = None, same_ids: bool = False) -> None:
    """Refuse vectors that fail a check. NULL, empty, short, long and non-finite vectors and repeated ids always count; ids
    missing on one side only with `same_ids`. An empty table passes unless `same_ids` finds products without vector."""
    counts = {r["check"]: r["value"] for r in embedding_checks(embeddings, products, dim).collect()}
    broken = {c: counts[c] for c in VECTOR_CHECKS + (ID_CHECKS if same_ids else ()) if counts[c]}
    if broken:
        raise UnfitTable("vectors are not fit for serving: " + ", ".join(f"{n} rows {c}" for c, n in broken.items()))


def require_profiles(features: DataFrame, embeddings: DataFrame, dim: int | None = None) -> None:
    """Refuse user rows with missing or repeated example ids, or with vectors of another length than the products' or values
    that are not finite. A user without vector passes, as does an empty table."""
    v = F.col("vector")
    broken = v.isNotNull() & (F.coalesce(_wrong_size(v, dim, longest(embeddings)), F.lit(False)) | ~is_finite(v))
    per_id = features.groupBy("example_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(broken, 1)).alias("bad"))
    found = per_id.agg(F.count(F.when(F.col("example_id").isNull() | (F.col("n") > 1), 1)).alias("repeated"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    if found["repeated"] or found["bad"]:
        raise UnfitTable(f"user rows are not fit for serving: {found['repeated']} ids missing or repeated, {found['bad']} broken vectors")
