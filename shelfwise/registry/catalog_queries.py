"""Scans, catalog joins, price rules, product features."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions import pricing, text
from shelfwise.operators import catalog, ranks
from shelfwise.params import DEFAULTS
from shelfwise.registry.core import long, query, r, ts_text


@query("scan_categories", "A1", "SELECT category_id, name, parent_id FROM x_cat")
def _(t):
    return t.categories


@query("scan_tags", "A2", "SELECT DISTINCT tag_id, word AS name FROM x_tagword")
def _(t):
    return t.tags


@query("scan_products", "A3", """
  SELECT product_id, category_id, slug, name, description, brand, price, sale_price, discount_percentage,
         stock_quantity, ingredients, is_active FROM x_prod""")
def _(t):
    return t.products.withColumn("is_active", F.col("is_active").cast("boolean")).withColumn("stock_quantity", long("stock_quantity"))


@query("scan_product_tags", "A4", "SELECT product_id, tag_id FROM x_tagword")
def _(t):
    return t.product_tags


@query("scan_users", "A5", "SELECT user_id, preferred_category, age_group FROM x_users")
def _(t):
    return catalog.users(t)


@query("scan_reviews", "A6", """
  SELECT user_id, product_id, rating, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM x_reviews""")
def _(t):
    return t.reviews.withColumn("created_at", ts_text("created_at"))


@query("scan_event_log", "A7", """
  SELECT event_id, user_id, product_id, signal, strftime(action_time, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM x_log""")
def _(t):
    from shelfwise.operators.history import signals
    return signals(t.events).withColumn("ts", ts_text("ts"))


@query("parse_event_times", "A8", """
  SELECT event_id, strftime(TRY_CAST(CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' || ts ELSE ts::VARCHAR END AS TIMESTAMP),
         '%Y-%m-%d %H:%M:%S.%f') AS parsed FROM events""")
def _(t):
    raw = F.when(F.col("event_id") % 10 == 0, None).when(F.col("event_id") % 10 == 1, F.concat(F.lit("n/a"), F.col("action_time").cast("string"))).otherwise(F.col("action_time").cast("string"))
    from shelfwise.sources.snapshots import parse_time
    return t.events.select("event_id", ts_text(parse_time(raw)).alias("parsed"))


@query("effective_price", "B1 B2", "SELECT product_id, effective_price, is_discounted FROM x_catalog")
def _(t):
    p, s = F.col("price"), F.col("sale_price")
    return t.products.select("product_id", pricing.effective_price(p, s).alias("effective_price"), pricing.is_discounted(p, s).alias("is_discounted"))


@query("price_tier", "B3", "SELECT product_id, price_tier FROM x_pf")
def _(t):
    return catalog.product_features(t, None).select("product_id", "price_tier")


@query("eligibility_rules", "B7 B8", """
  SELECT id AS candidate_id, coalesce(is_active AND stock_quantity > 0, false) AS eligible,
         concat_ws(',', CASE WHEN NOT coalesce(is_active, false) THEN 'is_active' END,
                        CASE WHEN NOT coalesce(stock_quantity > 0, false) THEN 'in_stock' END) AS reasons
  FROM (SELECT DISTINCT vec_id * 3 AS id FROM embeddings) LEFT JOIN x_catalog ON id = product_id""")
def _(t):
    from shelfwise.operators.eligibility import apply_rules
    ids = t.embeddings.select((F.col("product_id") * 3).alias("candidate_id")).distinct()
    out = apply_rules(ids, "candidate_id", catalog.denormalise(t), DEFAULTS.eligibility)
    return out.select("candidate_id", "eligible", F.array_join("reasons", ",").alias("reasons"))


@query("denormalised_products", "C1 C2", """
  SELECT c.product_id, c.category_name, c.parent_category_name, coalesce(t.tags, '') AS tags
  FROM x_catalog c LEFT JOIN (SELECT product_id, string_agg(word, ',' ORDER BY word) AS tags FROM x_tagword GROUP BY 1) t USING (product_id)""")
def _(t):
    return catalog.denormalise(t, with_tags=True).select("product_id", "category_name", "parent_category_name", F.array_join("tags", ",").alias("tags"))


@query("user_preferred_category", "C3", "SELECT user_id, preferred_category FROM x_users")
def _(t):
    return catalog.users(t).select("user_id", "preferred_category")


@query("product_popularity", "D1", """
  SELECT product_id, count(*) AS purchase_count, count(DISTINCT user_id) AS distinct_purchasers
  FROM x_log WHERE action_type = 'PURCHASE' GROUP BY 1""")
def _(t):
    return catalog.popularity(t.events)


@query("cart_add_counts", "D2", "SELECT product_id, count(*) AS cart_add_count FROM x_log WHERE action_type = 'ADD_TO_CART' GROUP BY 1")
def _(t):
    return catalog.cart_adds(t.events)


@query("review_stats", "D3", """
  SELECT product_id, round(avg(rating), 6) AS average_rating, count(*) AS review_count FROM x_reviews GROUP BY 1""")
def _(t):
    return catalog.review_stats(t.reviews).withColumn("average_rating", r("average_rating"))


@query("product_features", "D4", """
  SELECT product_id, category_name, parent_category_name, brand, price, effective_price, coalesce(discount_percentage, 0) AS discount_percentage,
         is_active, stock_quantity, is_discounted, price_tier, round(category_relative_price, 6) AS category_relative_price,
         purchase_count, distinct_purchasers, cart_add_count, review_count, round(average_rating, 6) AS average_rating FROM x_pf""")
def _(t):
    f = catalog.product_features(t, t.events)
    return f.select("product_id", "category_name", "parent_category_name", "brand", "price", "effective_price", "discount_percentage",
                    "is_active", long("stock_quantity").alias("stock_quantity"), "is_discounted", "price_tier",
                    r("category_relative_price").alias("category_relative_price"), "purchase_count", "distinct_purchasers",
                    "cart_add_count", "review_count", r("average_rating").alias("average_rating"))


@query("catalog_price_tertiles", "D5", "SELECT round(tier_lower, 6) AS tier_lower, round(tier_upper, 6) AS tier_upper FROM x_bounds")
def _(t):
    return catalog.price_context(catalog.denormalise(t)).select(r("tier_lower").alias("tier_lower"), r("tier_upper").alias("tier_upper"))


@query("price_statistics", "D6", """
  SELECT CASE WHEN grouping(category_name) = 1 THEN 'ALL' ELSE category_name END AS scope, count(*) AS products,
         round(median(effective_price), 6) AS median_price, round(stddev_pop(effective_price), 4) AS std_price
  FROM x_catalog GROUP BY GROUPING SETS ((category_name), ()) HAVING grouping(category_name) = 1 OR category_name IS NOT NULL""")
def _(t):
    s = catalog.price_statistics(catalog.denormalise(t))
    return s.select(F.when(F.col("whole_catalog") == 1, "ALL").otherwise(F.col("category_name")).alias("scope"), "products",
                    r("median_price").alias("median_price"), r("std_price", 4).alias("std_price"))


@query("category_relative_price", "E3", "SELECT product_id, round(category_relative_price, 6) AS category_relative_price FROM x_relprice")
def _(t):
    return catalog.product_features(t, None).select("product_id", r("category_relative_price").alias("category_relative_price"))


@query("global_popularity_rank", "E4 E6", """
  SELECT product_id, rn AS rank, round(CASE WHEN n <= 1 THEN 1 ELSE 1 - (rn - 1) / (n - 1)::DOUBLE END, 6) AS score FROM (
    SELECT product_id, row_number() OVER (ORDER BY purchase_count DESC, cart_add_count DESC, product_id) AS rn, count(*) OVER () AS n
    FROM x_pf WHERE eligible)""")
def _(t):
    f = catalog.product_features(t, t.events).where("eligible").select("product_id", "purchase_count", "cart_add_count")
    ranked = ranks.popularity_rank(f, [])
    return ranked.select("product_id", "rank", r(ranks.rank_score(F.col("rank"), F.col("group_size"))).alias("score"))


@query("category_popularity_rank", "E5", """
  SELECT category_name, product_id, row_number() OVER (PARTITION BY category_name ORDER BY purchase_count DESC, cart_add_count DESC, product_id) AS rank
  FROM x_pf WHERE eligible AND category_name IS NOT NULL""")
def _(t):
    f = catalog.product_features(t, t.events).where("eligible AND category_name IS NOT NULL")
    ranked = ranks.popularity_rank(f.select("category_name", "product_id", "purchase_count", "cart_add_count"), ["category_name"])
    return ranked.select("category_name", "product_id", "rank")


@query("top_eligible_per_category", "B1 D1 D2 B8 E5", """
  SELECT * FROM (SELECT category_name, product_id, effective_price, purchase_count, cart_add_count,
    row_number() OVER (PARTITION BY category_name ORDER BY purchase_count DESC, cart_add_count DESC, product_id) AS rank
    FROM x_pf WHERE eligible) WHERE rank <= 10""")
def _(t):
    w = W.partitionBy("category_name").orderBy(F.col("purchase_count").desc(), F.col("cart_add_count").desc(), "product_id")
    f = catalog.product_features(t, t.events).where("eligible")
    return f.select("category_name", "product_id", "effective_price", "purchase_count", "cart_add_count",
                    long(F.row_number().over(w)).alias("rank")).where("rank <= 10")


@query("product_text", "H1 H2", """
  SELECT c.product_id, substr(sha256(txt), 1, 16) AS content_hash, txt AS passage FROM (
    SELECT c.product_id, concat_ws(' ', name, 'Brand: ' || brand || '.',
       'Category: ' || CASE WHEN parent_category_name IS NOT NULL THEN parent_category_name || ' > ' || category_name ELSE category_name END || '.',
       'Tags: ' || t.tags || '.', description, 'Ingredients: ' || ingredients || '.') AS txt
    FROM x_catalog c LEFT JOIN (SELECT product_id, string_agg(word, ', ' ORDER BY word) AS tags FROM x_tagword GROUP BY 1) t USING (product_id)) c""")
def _(t):
    c = F.col
    d = catalog.denormalise(t, with_tags=True).select("product_id", text.product_text(
        c("name"), c("brand"), c("category_name"), c("parent_category_name"), c("tags"), c("description"), c("ingredients")).alias("passage"))
    return d.withColumn("content_hash", text.content_hash(c("passage")))


@query("normalised_names", "H3 H4", """
  SELECT p_partkey AS product_id, lower(trim('  ' || p_brand || ' ')) AS normalised,
         trim(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def _(t):
    return t.products.select("product_id", text.normalise(F.concat(F.lit("  "), "brand", F.lit(" "))).alias("normalised"),
                             text.slug(F.concat("brand", F.lit(" / "), "name", F.lit("!"))).alias("slug"))
