"""Data quality, reports, stores, diagnostics, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import affinity, catalog, eligibility, encode, history, price_neighbours, quality
from shelfwise.operators import candidates as cand
from shelfwise.params import DEFAULTS
from shelfwise.plans import evaluate, features, serve
from shelfwise.registry import catalog_queries, core, feature_queries, serve_queries  # noqa: F401
from shelfwise.registry.core import long, query, r, ts_text
from shelfwise.registry.ctes import CTES
from shelfwise.registry.ranking_queries import loo_eval, loo_ranking
from shelfwise.registry.temporal_queries import KS, long_metrics, metric_sql
from shelfwise.sources import embedding_store, mapped, reports, snapshots
from shelfwise.sources.bindings import EMBEDDING_DIM
from shelfwise.sources.stage import stage, stage_root

P = DEFAULTS


def fresh_path(t, name):
    """A new path in the shared folder."""
    import uuid
    root = stage_root(t.spark)
    if root is None:
        raise ValueError("stored tables need a folder that all machines share: set spark.checkpoint.dir")
    return f"{root}/shelfwise/{name}-{uuid.uuid4().hex}"


# --- foreign keys and consistency -------------------------------------------------------------------
_FKS = {
    "category.parent_id": ("SELECT parent_id AS v FROM x_cat", "SELECT category_id FROM x_cat"),
    "product.category_id": ("SELECT category_id AS v FROM x_prod", "SELECT category_id FROM x_cat"),
    "product_tag.product_id": ("SELECT product_id AS v FROM x_tagword", "SELECT product_id FROM x_prod"),
    "product_tag.tag_id": ("SELECT tag_id AS v FROM x_tagword", "SELECT tag_id FROM x_tagword"),
    "user.preferred_category_id": ("SELECT CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 97 = 5 THEN 999 ELSE 1 END::BIGINT AS v FROM customer", "SELECT category_id FROM x_cat"),
    "order.user_id": ("SELECT o_custkey AS v FROM orders", "SELECT c_custkey FROM customer"),
    "order_item.order_id": ("SELECT l_orderkey AS v FROM lineitem", "SELECT o_orderkey FROM orders"),
    "order_item.product_id": ("SELECT l_partkey AS v FROM lineitem", "SELECT p_partkey FROM part"),
    "cart.user_id": ("SELECT o_custkey AS v FROM orders WHERE o_orderstatus = 'O'", "SELECT c_custkey FROM customer"),
    "cart_item.cart_id": ("SELECT l_orderkey AS v FROM lineitem", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'"),
    "cart_item.product_id": ("SELECT l_partkey AS v FROM lineitem", "SELECT p_partkey FROM part"),
    "review.user_id": ("SELECT user_id AS v FROM x_reviews", "SELECT c_custkey FROM customer"),
    "review.product_id": ("SELECT product_id AS v FROM x_reviews", "SELECT p_partkey FROM part"),
    "click.user_id": ("SELECT user_id AS v FROM x_log WHERE signal = 'click'", "SELECT c_custkey FROM customer"),
    "click.product_id": ("SELECT product_id AS v FROM x_log WHERE signal = 'click'", "SELECT p_partkey FROM part"),
    "search.user_id": ("SELECT user_id AS v FROM x_log WHERE signal = 'search'", "SELECT c_custkey FROM customer"),
    "search.matched_product_id": ("SELECT CASE WHEN event_id % 4 <> 0 THEN product_id END AS v FROM x_log WHERE signal = 'search'", "SELECT p_partkey FROM part"),
    "chatbot.user_id": ("SELECT user_id AS v FROM x_log WHERE signal = 'chatbot'", "SELECT c_custkey FROM customer"),
    "chatbot.mentioned_product_id": ("SELECT product_id AS v FROM x_log WHERE signal = 'chatbot'", "SELECT p_partkey FROM part"),
}


@query("foreign_key_report", "C13", " UNION ALL ".join(
    f"SELECT '{n}' AS \"check\", count(DISTINCT v) AS dangling_values, count(*) AS dangling_rows FROM ({a}) WHERE v IS NOT NULL AND v NOT IN ({b})" for n, (a, b) in _FKS.items()))
def _(t):
    return quality.foreign_key_report(t)


@query("dangling_cart_items", "C13 C5", "SELECT l_orderkey AS value, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def _(t):
    return quality.dangling(t.cart_items, "cart_id", t.carts, "cart_id")


@query("pair_consistency", "C14", """
  WITH b AS (SELECT user_id, product_id FROM x_log WHERE signal = 'purchase'),
       o AS (SELECT o_custkey AS user_id, l_partkey AS product_id, o_orderstatus AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT 'purchase_without_order_line' AS rule, count(DISTINCT (user_id, product_id)) AS pairs, count(*) AS rows FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = b.user_id AND o.product_id = b.product_id)
  UNION ALL SELECT 'order_line_without_purchase', count(DISTINCT (user_id, product_id)), count(*) FROM o WHERE s IN ('F', 'P') AND NOT EXISTS (SELECT 1 FROM b WHERE o.user_id = b.user_id AND o.product_id = b.product_id)
  UNION ALL SELECT 'review_without_purchase', count(DISTINCT (user_id, product_id)), count(*) FROM x_reviews v WHERE NOT EXISTS (SELECT 1 FROM b WHERE v.user_id = b.user_id AND v.product_id = b.product_id)""")
def _(t):
    return quality.pair_consistency(t)


@query("users_without_events", "C15", "SELECT user_id FROM x_users WHERE user_id NOT IN (SELECT user_id FROM x_log)")
def _(t):
    return t.users.select("user_id").join(t.events.select("user_id").distinct(), "user_id", "left_anti")


@query("products_without_tag", "C15", "SELECT product_id FROM x_prod WHERE product_id NOT IN (SELECT product_id FROM x_tagword)")
def _(t):
    return t.products.select("product_id").join(t.product_tags.select("product_id").distinct(), "product_id", "left_anti")


@query("attribute_distributions", "C20", """
  SELECT 'users_by_preferred_category' AS what, coalesce(preferred_category, '(none)') AS value, count(*) AS rows FROM x_users GROUP BY 2
  UNION ALL SELECT 'users_by_age_group', age_group, count(*) FROM x_users GROUP BY 2 UNION ALL SELECT 'products_by_category', category_name, count(*) FROM x_catalog GROUP BY 2
  UNION ALL SELECT 'events_by_type', action_type, count(*) FROM x_log GROUP BY 2 UNION ALL SELECT 'reviews_by_rating', rating::INT::VARCHAR, count(*) FROM x_reviews GROUP BY 2
  UNION ALL SELECT 'orders_by_status', o_orderstatus, count(*) FROM orders GROUP BY 2""")
def _(t):
    users, cat = catalog.users(t), catalog.denormalise(t)
    parts = (("users_by_preferred_category", users, F.coalesce("preferred_category", F.lit("(none)"))), ("users_by_age_group", users, F.col("age_group")), ("products_by_category", cat, F.col("category_name")),
             ("events_by_type", t.events, F.col("action_type")), ("reviews_by_rating", t.reviews, F.col("rating").cast("int").cast("string")), ("orders_by_status", t.orders, F.col("status")))
    return quality.union_all([df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("what"), "value", "rows") for n, df, c in parts])


_PROFILED = (("products", "x_prod", ("product_id", "category_id", "slug", "name", "description", "brand", "price", "sale_price", "discount_percentage", "stock_quantity", "ingredients", "is_active")),
             ("events", "x_log", ("event_id", "user_id", "product_id", "action_time", "action_type")), ("users", "x_users", ("user_id", "age_group", "preferred_category")))


@query("null_counts", "D32", " UNION ALL ".join(
    f"""SELECT '{name}' AS "table", "column", (SELECT count(*) FROM {table}) AS rows, nulls FROM (UNPIVOT (SELECT {", ".join(f"count(*) - count({c}) AS {c}" for c in columns)} FROM {table})
    ON COLUMNS(*) INTO NAME "column" VALUE nulls)""" for name, table, columns in _PROFILED))
def _(t):
    tables = {"products": t.products, "events": t.events, "users": catalog.users(t)}
    return quality.union_all([quality.null_counts(tables[name].select(*columns), name) for name, _, columns in _PROFILED])


@query("duplicate_keys", "D32", """
  SELECT 'order_items' AS "table", count(*) AS duplicate_keys, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'products', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM part GROUP BY p_partkey HAVING count(*) > 1)
  UNION ALL SELECT 'events', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM x_log GROUP BY user_id, product_id, action_time, action_type HAVING count(*) > 1)
  UNION ALL SELECT 'event_ids', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM x_log GROUP BY event_id HAVING count(*) > 1)""")
def _(t):
    return quality.union_all([quality.duplicate_keys(t.order_items, ["order_id", "line"], "order_items"), quality.duplicate_keys(t.products, ["product_id"], "products"),
                              quality.duplicate_keys(t.events, ["user_id", "product_id", "action_time", "action_type"], "events"), quality.duplicate_keys(t.events, ["event_id"], "event_ids")])


@query("distinct_counts", "D32", "SELECT count(DISTINCT brand) AS brands, count(DISTINCT name) AS names, count(DISTINCT description) AS descriptions, count(DISTINCT slug) AS slugs, count(*) AS products FROM x_prod")
def _(t):
    # one column at a time keeps every distinct count a two-step aggregation
    return t.products.agg(F.countDistinct("brand").alias("brands"), F.countDistinct("name").alias("names"), F.countDistinct("description").alias("descriptions"), F.countDistinct("slug").alias("slugs"), F.count(F.lit(1)).alias("products"))


def _profile_sql(what, source, col):
    return f"""SELECT '{what}' AS what, count(*) AS rows, min({col})::DOUBLE AS min, round(quantile_cont({col}, 0.25), 6) AS p25, round(median({col}), 6) AS median, round(avg({col}), 6) AS mean,
    round(quantile_cont({col}, 0.75), 6) AS p75, round(quantile_cont({col}, 0.95), 6) AS p95, max({col})::DOUBLE AS max FROM {source} WHERE {col} IS NOT NULL"""


@query("numeric_profiles", "D33", " UNION ALL ".join((
    _profile_sql("price", "x_prod", "price"), _profile_sql("discount", "x_prod", "discount_percentage"),
    _profile_sql("events_per_user", "(SELECT count(*)::DOUBLE AS n FROM x_log GROUP BY user_id)", "n"), _profile_sql("events_per_product", "(SELECT count(*)::DOUBLE AS n FROM x_log GROUP BY product_id)", "n"))))
def _(t):
    per = lambda c: t.events.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    rows = quality.union_all([quality.numeric_profile(t.products, "price", "price"), quality.numeric_profile(t.products, "discount_percentage", "discount"),
                              quality.numeric_profile(per("user_id"), "n", "events_per_user"), quality.numeric_profile(per("product_id"), "n", "events_per_product")])
    return rows.select("what", "rows", "min", *[r(c).alias(c) for c in ("p25", "median", "mean", "p75", "p95")], "max")


@query("availability_cube", "D34", "SELECT is_active AS active, stock_quantity > 0 AS in_stock, count(*) AS products FROM x_prod GROUP BY CUBE (is_active, stock_quantity > 0)")
def _(t):
    return quality.availability_cube(t.products.withColumn("is_active", F.col("is_active").cast("boolean")))


@query("discount_consistency", "D34", """
  SELECT count(sale_price) AS on_sale, count(*) FILTER (sale_price > price) AS sale_above_price,
         count(*) FILTER (sale_price IS NOT NULL AND abs(discount_percentage - round((price - sale_price) / price * 100, 1)) > 0.2) AS percentage_off FROM x_prod""")
def _(t):
    return quality.discount_consistency(t.products)


@query("funnel_order", "D35", """
  SELECT count(*) FILTER (k IS NOT NULL AND p IS NOT NULL) AS cart_purchase_pairs, count(*) FILTER (k <= p) AS cart_before_purchase,
         count(*) FILTER (c IS NOT NULL AND k IS NOT NULL) AS click_cart_pairs, count(*) FILTER (c <= k) AS click_before_cart
  FROM (SELECT min(action_time) FILTER (signal = 'click') AS c, min(action_time) FILTER (signal = 'cart') AS k, min(action_time) FILTER (signal = 'purchase') AS p FROM x_log GROUP BY user_id, product_id)""")
def _(t):
    return quality.funnel_order(t.events)


def _depth(what, col, ks):
    return [f"SELECT '{what}' AS what, {k}::BIGINT AS k, count(*) FILTER ({col} >= {k}) AS value FROM d" for k in ks]


@query("activity_depth", "D36", """
  WITH d AS (SELECT user_id, count(DISTINCT action_time) AS t, count(DISTINCT action_time) FILTER (signal = 'purchase') AS pt, count(DISTINCT product_id) FILTER (signal = 'purchase') AS p FROM x_log GROUP BY 1)
  """ + " UNION ALL ".join(_depth("users_by_event_times", "t", (2, 5, 10)) + _depth("users_by_purchase_times", "pt", (2, 3)) + _depth("users_by_products", "p", (2, 3, 5))) + """
  UNION ALL SELECT 'repeat_purchase_pairs', 2, count(*) FROM (SELECT 1 FROM x_purch GROUP BY user_id, product_id HAVING count(*) > 1)""")
def _(t):
    return quality.activity_depth(t.events)


@query("dataset_summary", "D41", """
  SELECT 'users' AS what, count(*)::DOUBLE AS value FROM customer UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'categories', count(*) FROM x_cat
  UNION ALL SELECT 'tags', count(DISTINCT tag_id) FROM x_tagword UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'order_items', count(*) FROM lineitem
  UNION ALL SELECT 'reviews', count(*) FROM x_reviews UNION ALL SELECT 'events', count(*) FROM events
  UNION ALL SELECT 'share_users_with_purchases', round(count(DISTINCT user_id) / (SELECT count(*) FROM customer)::DOUBLE, 6) FROM x_log SEMI JOIN x_users USING (user_id) WHERE signal = 'purchase'
  UNION ALL SELECT 'share_users_with_carts', round(count(DISTINCT user_id) / (SELECT count(*) FROM customer)::DOUBLE, 6) FROM x_log SEMI JOIN x_users USING (user_id) WHERE signal = 'cart'
  UNION ALL SELECT 'share_incomplete_profiles', round(avg((c_custkey % 20 = 0 OR c_mktsegment IS NULL)::INT), 6) FROM customer""")
def _(t):
    return quality.dataset_summary(t).withColumn("value", r("value"))


@query("embedding_checks", "B24 G6", f"""
  SELECT 'rows' AS "check", count(*) AS value FROM embeddings UNION ALL SELECT 'empty', count(*) FROM embeddings WHERE embedding IS NULL OR len(embedding) = 0
  UNION ALL SELECT 'wrong_dim', count(*) FROM embeddings WHERE len(embedding) <> {EMBEDDING_DIM} UNION ALL SELECT 'not_finite', count(*) FROM embeddings WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0
  UNION ALL SELECT 'ids_not_in_catalog', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'catalog_without_vector', count(*) FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)
  UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT 1 FROM embeddings GROUP BY vec_id HAVING count(*) > 1)""")
def _(t):
    return quality.embedding_checks(t.embeddings, t.products, EMBEDDING_DIM)


@query("top_brands", "F13", "SELECT brand, count(*) AS products FROM x_prod GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return t.products.groupBy("brand").agg(F.count(F.lit(1)).alias("products")).orderBy(F.col("products").desc(), "brand").limit(5)


@query("listed_users", "F13", "SELECT user_id, preferred_category, age_group FROM x_users ORDER BY user_id")
def _(t):
    return catalog.users(t).orderBy("user_id")


# --- stores and snapshots ---------------------------------------------------------------------------
@query("product_lookup", "A20", """
  SELECT r.product_id, p.name, p.category_name FROM (SELECT DISTINCT o_custkey * 3 AS product_id FROM orders) r LEFT JOIN x_catalog p USING (product_id)""")
def _(t):
    asked = t.orders.select((F.col("user_id") * 3).alias("product_id")).distinct()
    return asked.join(catalog.denormalise(t).select("product_id", "name", "category_name"), "product_id", "left")


@query("user_scans", "A20", """
  SELECT u.user_id, count(*) FILTER (signal = 'click') AS clicks, count(*) FILTER (signal = 'search') AS searches, count(*) FILTER (signal = 'purchase') AS purchases FROM x_users u LEFT JOIN x_log l USING (user_id) GROUP BY 1""")
def _(t):
    per = lambda s: F.count(F.when(F.col("signal") == s, 1))
    c = history.signals(t.events).groupBy("user_id").agg(per("click").alias("clicks"), per("search").alias("searches"), per("purchase").alias("purchases"))
    return t.users.select("user_id").join(c, "user_id", "left").select("user_id", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("clicks", "searches", "purchases")])


@query("snapshot_events", "A9 A10 A18 H18", "SELECT event_id, user_id, product_id, action_type, strftime(action_time, '%Y-%m-%d %H:%M:%S.%f') AS action_time FROM x_log")
def _(t):
    path = fresh_path(t, "snapshot")
    snapshots.save({"events": t.events}, path)
    return snapshots.read(t.spark, path, {"events": t.events.schema})["events"].withColumn("action_time", ts_text("action_time"))


@query("snapshot_products", "A9 A10 H18", "SELECT product_id, category_id, slug, name, description, brand, price, sale_price, discount_percentage, stock_quantity, ingredients, is_active::INT::BIGINT AS is_active FROM x_prod")
def _(t):
    path = fresh_path(t, "snapshot")
    snapshots.save({"products": t.products}, path)
    p = snapshots.read(t.spark, path, {"products": t.products.schema})["products"]
    return p.withColumn("stock_quantity", long("stock_quantity")).withColumn("is_active", long("is_active"))


#: A store with names of its own: ids as text, prices in cents, and orders and carts in one folder.
SHOP = {
    "categories": mapped.Stored("groups", "id string, label string, above string", {"category_id": "id", "name": "label", "parent_id": "above"}),
    "products": mapped.Stored("articles", "id string, grp string, slug string, title string, about string, maker string, cents bigint, saleCents bigint, off double, stock int, made_of string, live boolean", {
        "product_id": "id", "category_id": "grp", "name": "title", "description": "about", "brand": "maker", "price": "cents / 100", "sale_price": "saleCents / 100",
        "discount_percentage": "off", "stock_quantity": "stock", "ingredients": "made_of", "is_active": "int(live)"}),
    "users": mapped.Stored("people", "id string, likes string, age string", {"user_id": "id", "preferred_category_id": "likes", "age_group": "age"}),
    "events": mapped.Stored("log", "id bigint, who string, what string, did string, at timestamp_ntz", {
        "event_id": "id", "user_id": "who", "product_id": "what", "action_type": "upper(did)", "action_time": "at"}),
    "orders": mapped.Stored("baskets", "id string, who string, state string, at timestamp_ntz", {"order_id": "id", "user_id": "who", "status": "state", "created_at": "at"}),
    "carts": mapped.Stored("baskets", "id string, who string, state string", {"cart_id": "id", "user_id": "who"}, "state = 'O'"),
    "order_items": mapped.Stored("basket_lines", "basket string, n int, what string, pieces double, each double", {"order_id": "basket", "line": "n", "product_id": "what", "quantity": "pieces", "unit_price": "each"}),
    "cart_items": mapped.Stored("basket_lines", "basket string, what string, pieces double", {"cart_id": "basket", "product_id": "what", "quantity": "pieces"}),
    "reviews": mapped.Stored("opinions", "who string, what string, stars double, at timestamp_ntz", {"user_id": "who", "product_id": "what", "rating": "stars", "created_at": "at"}),
}


def as_shop(t, path):
    """The tables saved as such a store, and bound through its mapping."""
    text_id, cents, c = (lambda x: F.col(x).cast("string")), (lambda x: F.round(F.col(x) * 100).cast("bigint")), F.col
    snapshots.save({
        "groups": t.categories.select(text_id("category_id").alias("id"), c("name").alias("label"), text_id("parent_id").alias("above")),
        "articles": t.products.select(text_id("product_id").alias("id"), text_id("category_id").alias("grp"), "slug", c("name").alias("title"), c("description").alias("about"), c("brand").alias("maker"),
                                      cents("price").alias("cents"), cents("sale_price").alias("saleCents"), c("discount_percentage").alias("off"), c("stock_quantity").alias("stock"),
                                      c("ingredients").alias("made_of"), c("is_active").cast("boolean").alias("live")),
        "people": t.users.select(text_id("user_id").alias("id"), text_id("preferred_category_id").alias("likes"), c("age_group").alias("age")),
        "log": t.events.select(c("event_id").alias("id"), text_id("user_id").alias("who"), text_id("product_id").alias("what"), F.lower("action_type").alias("did"), c("action_time").alias("at")),
        "baskets": t.orders.select(text_id("order_id").alias("id"), text_id("user_id").alias("who"), c("status").alias("state"), c("created_at").cast("timestamp_ntz").alias("at")),
        "basket_lines": t.order_items.select(text_id("order_id").alias("basket"), c("line").alias("n"), text_id("product_id").alias("what"), c("quantity").alias("pieces"), c("unit_price").alias("each")),
        "opinions": t.reviews.select(text_id("user_id").alias("who"), text_id("product_id").alias("what"), c("rating").alias("stars"), c("created_at").cast("timestamp_ntz").alias("at")),
    }, path)
    return mapped.load(t.spark, path, SHOP)


for _base, _ids in (("product_features", "A18 D4"), ("engagement_counts", "A18 D14"), ("user_price_profile", "A18 D7"), ("cart_contents", "A18 C5"), ("engagement_profile_rows", "A18 C6")):
    @query(f"shop_{_base}", _ids)
    def _(t, _base=_base):
        return core.BODIES[_base](as_shop(t, fresh_path(t, "shop")))
    core.SQL[f"shop_{_base}"] = core.SQL[_base]


@query("embedding_store_roundtrip", "A11 A13", "SELECT vec_id AS product_id, pos, round(v, 6) AS value FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)")
def _(t):
    path = fresh_path(t, "vectors")
    embedding_store.save(t.embeddings.withColumn("content_hash", text.content_hash(F.col("product_id").cast("string"))), path, "given")
    v = embedding_store.read_vectors(t.spark, path)
    return v.select("product_id", F.posexplode("embedding").alias("pos", "value")).select("product_id", long("pos").alias("pos"), r(F.col("value").cast("double")).alias("value"))


def _texts(t):
    c = F.col
    return catalog.denormalise(t, with_tags=True).select("product_id", text.product_text(c("name"), c("brand"), c("category_name"), c("parent_category_name"), c("tags"), c("description"), c("ingredients")).alias("text"))


@query("embedding_refresh_plan", "A12 G6", """
  SELECT coalesce(p.p_partkey, o.id) AS product_id, CASE WHEN p.p_partkey IS NULL THEN 'drop' WHEN o.id IS NULL OR p_size % 5 = 0 THEN 'encode' ELSE 'keep' END AS action
  FROM part p FULL JOIN (SELECT o_orderkey AS id FROM orders) o ON o.id = p.p_partkey""")
def _(t):
    now = _texts(t).withColumn("content_hash", text.content_hash(F.col("text"))).select("product_id", "content_hash")
    ids = t.orders.select(F.col("order_id").alias("product_id"))
    # the stored side was written when products had no ingredients
    bare = catalog.denormalise(t, with_tags=True)
    c = F.col
    old = bare.select("product_id", text.content_hash(text.product_text(c("name"), c("brand"), c("category_name"), c("parent_category_name"), c("tags"), c("description"), F.lit(None).cast("string"))).alias("content_hash"))
    stored = ids.join(old, "product_id", "left").select("product_id", F.coalesce("content_hash", F.lit("gone")).alias("content_hash"), F.lit("m").alias("model_name"))
    return embedding_store.plan_refresh(now, stored, "m")


@query("dataset_fingerprint", "A16", """
  SELECT count(*) AS rows, substr(sha256(count(*)::VARCHAR || ':' || coalesce(sum(h), 0)::VARCHAR), 1, 16) AS fingerprint FROM (
    SELECT ('0x' || substr(md5(concat_ws('|', event_id, user_id, product_id, action_type, strftime(action_time, '%Y-%m-%d %H:%M:%S.%f'))), 1, 15))::BIGINT::HUGEINT AS h FROM x_log)""")
def _(t):
    return snapshots.fingerprint(t.events)


@query("stored_vocabularies", "A17", """
  SELECT 'category' AS vocab, category_name AS value, row_number() OVER (ORDER BY category_name) AS idx FROM (SELECT DISTINCT category_name FROM x_catalog WHERE category_name IS NOT NULL)
  UNION ALL SELECT 'brand', brand, row_number() OVER (ORDER BY brand) FROM (SELECT DISTINCT brand FROM x_catalog WHERE brand IS NOT NULL)""")
def _(t):
    path, cat = fresh_path(t, "encoder"), catalog.denormalise(t)
    encode.save_vocabularies({"category": encode.vocabulary(cat, "category_name"), "brand": encode.vocabulary(cat, "brand")}, cat.agg(F.max("price").alias("max_price")), path)
    v, _top = encode.load_vocabularies(t.spark, ["category", "brand"], path)
    return quality.union_all([v[n].select(F.lit(n).alias("vocab"), "value", "idx") for n in v])


CTES["x_servedmean"] = metric_sql("x_servedrank")


@query("offline_report", "A14 A15 J10 H18", "SELECT split, cases, metric, k, value, 10::INT AS top_n, 1::INT AS schema_version FROM x_servedmean")
def _(t):
    tc, _, rec = evaluate.evaluate_recommendations(t)
    m = evaluate.evaluate_lists(evaluate.as_ranked(rec.items), tc.relevant, tc.ids, KS, ["split"])
    mark = snapshots.fingerprint(t.events).first()["fingerprint"]
    who = {"run_id": "run", "ranker_model_version": "retrieval-order", "retrieval_model_version": "content", "data_source": "events", "dataset_fingerprint": mark}
    path = fresh_path(t, "report")
    reports.save(reports.build(m, who, 10, P.features.recency.half_life_days, "2024-01-31T00:00:00"), path)
    report = reports.load(t.spark, path)
    reports.validate(report, who)
    return long_metrics(report.select("split", "cases", "metric", "k", "value", "top_n", "schema_version"))


# --- displays and diagnostics -----------------------------------------------------------------------
@query("engagement_display", "C19 H5", """
  SELECT s.user_id, s.product_id, s.signal, coalesce(p.name, '(unknown product)') AS product_name, coalesce(t.keywords, '') AS keywords FROM
    (SELECT DISTINCT user_id, product_id * 30 AS product_id, signal FROM x_log) s LEFT JOIN x_prod p USING (product_id)
  LEFT JOIN (SELECT product_id, string_agg(word, ', ' ORDER BY word) AS keywords FROM x_tagword GROUP BY 1) t ON t.product_id = p.product_id""")
def _(t):
    rows = history.signals(t.events).select("user_id", (F.col("product_id") * 30).alias("product_id"), "signal").distinct()
    names = t.products.select("product_id", "name").join(catalog.tag_arrays(t.product_tags, t.tags), "product_id", "left")
    return rows.join(names, "product_id", "left").select("user_id", "product_id", "signal", F.coalesce("name", F.lit("(unknown product)")).alias("product_name"), F.coalesce(F.array_join("tags", ", "), F.lit("")).alias("keywords"))


@query("user_snapshots", "J11", """
  SELECT t.user_id, t.tier, c.total_engagement_events, t.top_category, round(a.weight, 6) AS top_weight, n.names AS purchased FROM x_livetier t JOIN x_livecounts c USING (user_id)
  LEFT JOIN (SELECT * FROM x_livecat WHERE rank = 1) a ON a.example_id = t.user_id
  LEFT JOIN (SELECT user_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM x_purch JOIN x_prod USING (product_id) GROUP BY 1) n ON n.user_id = t.user_id""")
def _(t):
    users, cat = catalog.users(t), catalog.denormalise(t)
    ex = features.live_examples(users)
    hist = stage(history.live_history(history.signals(t.events), P.features.recency, features.latest_time(t.events)), "history")
    top = affinity.category_affinity(hist, cat, ex, users, P.features).where("rank = 1").select("example_id", F.col("name").alias("top_category"), r("weight").alias("top_weight"))
    named = hist.where("signal = 'purchase'").join(cat.select("product_id", "name"), "product_id").select("example_id", "name").distinct()
    bought = named.groupBy("example_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("purchased"))
    n = history.engagement_counts(hist, ex).withColumn("tier", cand.history_tier(F.col("total_engagement_events"), P.cold_start))
    return n.join(top, "example_id", "left").join(bought, "example_id", "left").select("user_id", "tier", "total_engagement_events", "top_category", "top_weight", "purchased")


@query("price_neighbours", "F12 J13", """
  WITH s AS (SELECT product_id, effective_price, row_number() OVER (ORDER BY effective_price, product_id) - 1 AS i, count(*) OVER () AS n FROM x_catalog),
  u AS (SELECT user_id, typical_price, (SELECT count(*) FROM s WHERE s.effective_price < x_liveprice.typical_price) AS idx FROM x_liveprice)
  SELECT u.user_id, round(u.typical_price, 6) AS typical_price, c.product_id AS close_id, c.effective_price AS close_price, f.product_id AS far_id, f.effective_price AS far_price
  FROM u JOIN s c ON c.i = least(u.idx, c.n - 1) JOIN s f ON f.i = CASE WHEN u.idx > f.n / 2.0 THEN 0 ELSE f.n - 1 END""")
def _(t):
    users, cat = catalog.users(t), catalog.denormalise(t)
    hist = history.live_history(history.signals(t.events), P.features.recency, features.latest_time(t.events))
    prof = affinity.price_profiles(affinity.price_summary(affinity.purchase_prices(hist, cat)), features.live_examples(users), users, cat, catalog.price_context(cat), catalog.category_prices(cat))
    prof = stage(prof.select("user_id", "typical_price"), "typical_prices")
    return price_neighbours.close_and_far(prof, cat).withColumn("typical_price", r("typical_price"))


@query("products_per_tier", "J13 B3", "SELECT price_tier, count(*) AS products, min(effective_price) AS cheapest, max(effective_price) AS dearest FROM x_pf GROUP BY 1")
def _(t):
    return catalog.product_features(t, None).groupBy("price_tier").agg(F.count(F.lit(1)).alias("products"), F.min("effective_price").alias("cheapest"), F.max("effective_price").alias("dearest"))


@query("eligibility_quadrants", "J15 B8", """
  SELECT is_active, stock_quantity > 0 AS in_stock, count(*) AS products, min(product_id) AS example_id, bool_and(is_active AND stock_quantity > 0) AS eligible FROM x_prod GROUP BY 1, 2""")
def _(t):
    cat = catalog.denormalise(t)
    checked = eligibility.apply_rules(cat.select("product_id"), "product_id", cat, P.eligibility).join(cat.select("product_id", "is_active", "stock_quantity"), "product_id")
    return checked.groupBy("is_active", (F.col("stock_quantity") > 0).alias("in_stock")).agg(F.count(F.lit(1)).alias("products"), F.min("product_id").alias("example_id"), F.min("eligible").alias("eligible"))


# --- leave-one-out pipeline evaluation --------------------------------------------------------------
CTES["x_loouser"] = "SELECT example_id, user_id FROM x_looex WHERE product_id IS NULL"
serve_queries.tiered("(SELECT * FROM x_loocounts JOIN x_loouser USING (example_id, user_id))", "x_loocat", "x_loousertier")
CTES["x_own_x_loousertier"] = serve_queries.own_sql("x_loousertier", "x_loovecs", "x_elig")
CTES["x_pool_x_loousertier"] = serve_queries.lists_sql("x_loousertier", "x_loovecs", "x_elig")
CTES["x_greedy_x_pool_x_loousertier"] = serve_queries.greedy_sql("x_pool_x_loousertier", 10)
CTES["x_final_x_loousertier"] = serve_queries.final_sql("x_pool_x_loousertier", 10)
CTES["x_looserved"] = "SELECT example_id AS case_id, rank, product_id AS item_id FROM x_final_x_loousertier"
CTES["x_loopool"] = "SELECT example_id AS case_id, pos AS rank, product_id AS item_id FROM x_pool_x_loousertier"
_LOO_CASES = "(SELECT -user_id - 1 AS case_id, 'test' AS split FROM x_loorole WHERE role = 'test')"


@query("loo_served_metrics", "J7 J6 D20 D23", f"""
  SELECT 'served' AS arm, * FROM ({metric_sql("x_looserved", cases=_LOO_CASES, relevant="x_looevalrel")})
  UNION ALL SELECT 'before_rerank', * FROM ({metric_sql("x_loopool", cases=_LOO_CASES, relevant="x_looevalrel")})""")
def _(t):
    cat, l, f = loo_ranking(t)
    cases, relevant = loo_eval(t, f, l)
    rec = serve.recommend(f.where("example_id < 0"), cat, t.embeddings, P)
    arms = {"served": evaluate.as_ranked(rec.items), "before_rerank": evaluate.as_ranked(rec.pool.withColumnRenamed("position", "rank"))}
    return long_metrics(quality.union_all([evaluate.evaluate_lists(df, relevant, cases, KS, ["split"]).withColumn("arm", F.lit(n)) for n, df in arms.items()]))
