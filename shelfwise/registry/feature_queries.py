"""Signals, recency, affinities, vectors, price profiles, the whole feature plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import pricing, recency, vectors
from shelfwise.operators import affinity, catalog, history, orders
from shelfwise.params import DEFAULTS, Recency
from shelfwise.plans import features
from shelfwise.registry.core import long, query, r, ts_text
from shelfwise.sources.bindings import COUNTED_ORDER_STATUSES, EMBEDDING_DIM

P = DEFAULTS.features


def live_history(t, decayed=True):
    sig = history.signals(t.events)
    return history.live_history(sig, P.recency, features.latest_time(t.events) if decayed else None)


@query("signal_fanout", "B10", """
  SELECT user_id, product_id, signal, 1::BIGINT AS quantity, strftime(action_time, '%Y-%m-%d %H:%M:%S.%f') AS action_time FROM x_log""")
def _(t):
    return history.signals(t.events).select("user_id", "product_id", "signal", F.lit(1).cast("bigint").alias("quantity"), ts_text("ts").alias("action_time"))


@query("counted_order_purchases", "B11 C4", """
  SELECT o_custkey AS user_id, l_partkey AS product_id, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, o_orderstatus AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'P')""")
def _(t):
    o = orders.counted_purchases(t.orders, t.order_items, COUNTED_ORDER_STATUSES)
    return o.select("user_id", "product_id", "quantity", "unit_price", "status")


@query("cart_contents", "C5", """
  SELECT o_custkey AS user_id, l_partkey AS product_id, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'""")
def _(t):
    return orders.cart_contents(t.carts, t.cart_items)


@query("engagement_profile_rows", "C6", """
  SELECT s.user_id, u.preferred_category, u.age_group, s.signal, s.product_id FROM (
    SELECT user_id, signal, product_id FROM x_log UNION ALL SELECT user_id, 'review', product_id FROM x_reviews) s
  LEFT JOIN x_users u USING (user_id)""")
def _(t):
    rows = history.signals(t.events).select("user_id", "signal", "product_id").unionByName(
        t.reviews.select("user_id", F.lit("review").alias("signal"), "product_id"))
    return rows.join(catalog.users(t), "user_id", "left").select("user_id", "preferred_category", "age_group", "signal", "product_id")


@query("event_weights", "B20 H6 H7 H8", """
  SELECT event_id, round(date_diff('microsecond', action_time, now) / 8.64e10::DOUBLE, 6) AS age_days,
         round(base * pow(0.5::DOUBLE, date_diff('microsecond', action_time, now) / 8.64e10::DOUBLE / 21.0::DOUBLE), 6) AS weight
  FROM x_log JOIN x_weights USING (signal) CROSS JOIN x_now""")
def _(t):
    rows = history.signals(t.events).withColumn("now", features.latest_time(t.events))
    weight = recency.effective_weight(affinity.base_weight(P), F.col("ts"), F.col("now"), P.recency)
    return rows.select("event_id", r(recency.age_days(F.col("ts"), F.col("now"))).alias("age_days"), r(weight).alias("weight"))


@query("decay_table", "H9", """
  SELECT age, n, round(pow(0.5::DOUBLE, age / 21.0::DOUBLE), 6) AS weight, floor_events FROM (
    SELECT unnest([0, 7, 30, 60, 120, 210])::BIGINT AS age) CROSS JOIN (SELECT count(*) AS n FROM x_log)
  JOIN LATERAL (SELECT count(*) AS floor_events FROM x_log, x_now WHERE date_diff('microsecond', action_time, now) / 8.64e10::DOUBLE >= age) ON true""")
def _(t):
    now = features.latest_time(t.events)
    ages = t.events.select(recency.age_days(F.col("action_time"), now).alias("age_days"))
    steps = [0, 7, 30, 60, 120, 210]
    agg = ages.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("age_days") >= a, 1)).alias(f"a{a}") for a in steps])
    rows = F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("age"), F.col(f"a{a}").alias("floor_events")) for a in steps]))
    return agg.select("n", rows.alias("s")).select(
        "s.age", "n", r(F.pow(F.lit(0.5), F.col("s.age") / P.recency.half_life_days)).alias("weight"), "s.floor_events")


@query("events_per_day", "H10", "SELECT strftime(action_time, '%Y-%m-%d') AS day, count(*) AS events FROM x_log GROUP BY 1")
def _(t):
    return t.events.groupBy(F.date_format(F.to_date("action_time"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("events"))


@query("chatbot_context", "D13", """
  SELECT user_id, product_id, count(*) AS mentions, strftime(max(max(action_time)) OVER (PARTITION BY user_id), '%Y-%m-%d %H:%M:%S.%f') AS chat_time
  FROM x_log WHERE action_type = 'CHATBOT' GROUP BY 1, 2""")
def _(t):
    return history.chatbot_context(t.events).withColumn("chat_time", ts_text("chat_time"))


@query("engagement_counts", "D14", """
  SELECT user_id, click_count, purchase_count, distinct_products_purchased, cart_item_count, search_count, has_chatbot_context, total_engagement_events
  FROM x_livecounts""")
def _(t):
    return history.engagement_counts(live_history(t, False), features.live_examples(catalog.users(t))).drop("example_id")


@query("signal_attributes", "C7", """
  SELECT event_id, signal, category_name, brand, effective_price FROM x_log JOIN x_catalog USING (product_id)""")
def _(t):
    attrs = catalog.denormalise(t).select("product_id", "category_name", "brand", "effective_price")
    return history.signals(t.events).join(attrs, "product_id").select("event_id", "signal", "category_name", "brand", "effective_price")


@query("signal_embeddings", "C8", """
  SELECT event_id, signal, round(embedding[1]::DOUBLE, 6) AS first_value, len(embedding)::BIGINT AS dim
  FROM x_log JOIN embeddings ON product_id = vec_id""")
def _(t):
    return history.signals(t.events).join(t.embeddings, "product_id").select(
        "event_id", "signal", r(F.col("embedding")[0].cast("double")).alias("first_value"), long(F.size("embedding")).alias("dim"))


@query("category_affinity", "D8 D10", """
  SELECT example_id AS user_id, name, round(weight, 6) AS weight, rank FROM x_livecat""")
def _(t):
    users = catalog.users(t)
    a = affinity.category_affinity(live_history(t), catalog.denormalise(t), features.live_examples(users), users, P)
    return a.select(F.col("example_id").alias("user_id"), "name", r("weight").alias("weight"), long("rank").alias("rank"))


@query("brand_affinity", "D9 D10", "SELECT example_id AS user_id, name, round(weight, 6) AS weight, rank FROM x_livebrand")
def _(t):
    a = affinity.brand_affinity(live_history(t), catalog.denormalise(t), P)
    return a.select(F.col("example_id").alias("user_id"), "name", r("weight").alias("weight"), long("rank").alias("rank"))


@query("top_affinity_category", "F5", "SELECT example_id AS user_id, name AS top_category FROM x_livecat WHERE rank = 1")
def _(t):
    users = catalog.users(t)
    a = affinity.category_affinity(live_history(t), catalog.denormalise(t), features.live_examples(users), users, P)
    return affinity.top_category(a).select(F.col("example_id").alias("user_id"), "top_category")


@query("signal_vectors", "D11", """
  SELECT example_id AS user_id, signal, pos, round(m, 6) AS value, round(eff, 6) AS blend_weight FROM (
    SELECT h.example_id, h.signal, e.pos, sum(h.w * e.v) / sum(h.w) AS m, max(h.base) * avg(h.w) AS eff
    FROM x_livehist h JOIN x_emb e USING (product_id) GROUP BY 1, 2, 3)""")
def _(t):
    s = affinity.signal_vectors(live_history(t), t.embeddings, P, EMBEDDING_DIM)
    s = s.select(F.col("example_id").alias("user_id"), "signal", r("blend_weight").alias("blend_weight"), F.posexplode("vector").alias("pos", "value"))
    return s.withColumn("pos", long("pos")).withColumn("value", r("value"))


@query("user_vectors", "D12", "SELECT example_id AS user_id, pos, round(v, 6) AS value FROM x_livevec")
def _(t):
    s = affinity.user_vectors(affinity.signal_vectors(live_history(t), t.embeddings, P, EMBEDDING_DIM), EMBEDDING_DIM)
    return s.select(F.col("example_id").alias("user_id"), F.posexplode("vector").alias("pos", "value")).withColumn("pos", long("pos")).withColumn("value", r("value"))


@query("user_price_profile", "B5 D7", """
  SELECT user_id, round(typical_price, 6) AS typical_price, round(price_spread, 4) AS price_spread, supporting_purchase_count, fallback_source, price_tier
  FROM x_liveprice""")
def _(t):
    users, cat = catalog.users(t), catalog.denormalise(t)
    summary = affinity.price_summary(affinity.purchase_prices(live_history(t), cat))
    p = affinity.price_profiles(summary, features.live_examples(users), users, cat, catalog.price_context(cat), catalog.category_prices(cat))
    return p.select("user_id", r("typical_price").alias("typical_price"), r("price_spread", 4).alias("price_spread"),
                    "supporting_purchase_count", "fallback_source", "price_tier")


@query("order_price_profile", "B5 D7 C4", """
  SELECT o_custkey AS user_id, round(avg(l_extendedprice / l_quantity), 6) AS typical_price, round(stddev_pop(l_extendedprice / l_quantity), 3) AS price_spread,
         count(*) AS supporting_purchase_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'P') GROUP BY 1""")
def _(t):
    bought = orders.counted_purchases(t.orders, t.order_items, COUNTED_ORDER_STATUSES)
    hist = orders.order_history(bought)
    s = affinity.price_summary(affinity.purchase_prices(hist, catalog.denormalise(t)))
    return s.select(F.col("example_id").alias("user_id"), r("own_typical").alias("typical_price"), r("own_spread", 3).alias("price_spread"),
                    F.col("own_count").alias("supporting_purchase_count"))


@query("order_category_affinity", "B11 D8", """
  SELECT user_id, name, round(v / sum(v) OVER (PARTITION BY user_id), 10) AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(v, 12) DESC, name) AS rn FROM (
      SELECT o_custkey AS user_id, category_name AS name, sum(0.45::DOUBLE * l_quantity) AS v
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN x_catalog ON product_id = l_partkey
      WHERE o_orderstatus IN ('F', 'P') GROUP BY 1, 2)) WHERE rn <= 5""")
def _(t):
    hist = orders.order_history(orders.counted_purchases(t.orders, t.order_items, COUNTED_ORDER_STATUSES))
    a = affinity.top_normalised(affinity.contributions(hist, catalog.denormalise(t), "category_name", P), P.max_top_categories)
    return a.select(F.col("example_id").alias("user_id"), "name", r("weight", 10).alias("weight"))


@query("price_distance", "B4 H12", """
  SELECT event_id, round(CASE WHEN typical_price IS NULL THEN 0 ELSE abs(effective_price - typical_price) / greatest(typical_price, 1e-6) END, 6) AS distance,
         round(least(effective_price / max_price, 1.0::DOUBLE), 6) AS normalised_price
  FROM x_log JOIN x_catalog USING (product_id) LEFT JOIN x_liveprice USING (user_id) CROSS JOIN (SELECT max_price FROM x_bounds)""")
def _(t):
    users, cat = catalog.users(t), catalog.denormalise(t)
    summary = affinity.price_summary(affinity.purchase_prices(live_history(t), cat))
    prof = affinity.price_profiles(summary, features.live_examples(users), users, cat, catalog.price_context(cat), catalog.category_prices(cat))
    top = catalog.price_context(cat).select("max_price").scalar()
    rows = t.events.join(cat.select("product_id", "effective_price"), "product_id").join(prof.select("user_id", "typical_price"), "user_id", "left")
    rows = rows.withColumn("max_price", top)
    return rows.select("event_id", r(pricing.relative_distance(F.col("effective_price"), F.col("typical_price"))).alias("distance"),
                       r(pricing.normalised(F.col("effective_price"), F.col("max_price"))).alias("normalised_price"))


@query("derived_orders", "D38", """
  SELECT user_id, strftime(action_time, '%Y-%m-%d') AS day, strftime(min(action_time), '%Y-%m-%d %H:%M:%S.%f') AS created_at,
         count(*) AS lines, round(sum(price), 2) AS total
  FROM x_purch JOIN x_prod USING (product_id) GROUP BY 1, 2""")
def _(t):
    return orders.derive_orders(t.events, t.products).withColumn("created_at", ts_text("created_at")).withColumn("total", r("total", 2))


@query("current_carts", "D39", """
  SELECT user_id, product_id FROM (
    SELECT user_id, product_id, max(action_time) FILTER (action_type = 'ADD_TO_CART') AS a, max(action_time) FILTER (action_type = 'PURCHASE') AS p
    FROM x_log GROUP BY 1, 2) WHERE a IS NOT NULL AND (p IS NULL OR a > p)""")
def _(t):
    return orders.current_carts(t.events)


@query("first_purchases", "D40", """
  SELECT user_id, product_id, strftime(min(action_time), '%Y-%m-%d %H:%M:%S.%f') AS first_time FROM x_purch GROUP BY 1, 2""")
def _(t):
    return orders.first_purchases(t.events).withColumn("first_time", ts_text("first_time"))


@query("log1p_counts", "H11", """
  SELECT product_id, round(ln(1 + purchase_count), 6) AS log_purchases, round(ln(1 + review_count), 6) AS log_reviews FROM x_pf""")
def _(t):
    f = catalog.product_features(t, t.events)
    return f.select("product_id", r(F.log1p("purchase_count")).alias("log_purchases"), r(F.log1p("review_count")).alias("log_reviews"))


@query("vector_cosine", "H13 H14", """
  SELECT a.product_id, b.product_id AS other_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS cosine,
         round(list_dot_product(list_transform(a.vec, lambda x: x / sqrt(list_dot_product(a.vec, a.vec))), b.vec), 6) AS unit_dot
  FROM x_vecs a JOIN x_vecs b ON b.product_id = a.product_id + 1""")
def _(t):
    a = t.embeddings
    b = t.embeddings.select(F.col("product_id").alias("other_id"), F.col("embedding").alias("other"), (F.col("product_id") - 1).alias("product_id"))
    j = a.join(b, "product_id")
    return j.select("product_id", "other_id", r(vectors.cosine(F.col("embedding"), F.col("other"))).alias("cosine"),
                    r(vectors.dot(vectors.l2_normalise(F.col("embedding")), F.col("other"))).alias("unit_dot"))


@query("user_features", "J1", """
  SELECT c.user_id, purchase_count, total_engagement_events, has_chatbot_context, t.name AS top_category,
         round(typical_price, 6) AS typical_price, price_tier, fallback_source, v.vec IS NOT NULL AS has_vector,
         round(coalesce(list_dot_product(v.vec, v.vec), 0), 6) AS squared_norm, coalesce(b.brands, 0) AS brands
  FROM x_livecounts c JOIN x_liveprice p USING (user_id) LEFT JOIN (SELECT * FROM x_livecat WHERE rank = 1) t ON t.example_id = c.user_id
  LEFT JOIN x_livevecs v ON v.example_id = c.user_id
  LEFT JOIN (SELECT example_id, count(*) AS brands FROM x_livebrand GROUP BY 1) b ON b.example_id = c.user_id""")
def _(t):
    cat = features.build_catalog(t)
    f = features.live_user_features(t, cat)
    return f.select("user_id", "purchase_count", "total_engagement_events", "has_chatbot_context", "top_category",
                    r("typical_price").alias("typical_price"), "price_tier", "fallback_source", F.col("vector").isNotNull().alias("has_vector"),
                    r(F.coalesce(vectors.dot(F.col("vector"), F.col("vector")), F.lit(0.0))).alias("squared_norm"), long(F.size("brand_affinity")).alias("brands"))


@query("recency_comparison", "D43", """
  WITH flat AS (SELECT example_id, user_id, signal, product_id, base, 1.0::DOUBLE AS w FROM x_livehist),
  off AS (SELECT example_id, name, sum(v) AS v FROM (SELECT example_id, category_name AS name, base * w AS v FROM flat JOIN x_catalog USING (product_id)
          UNION ALL SELECT example_id, preferred_category, 0.5::DOUBLE FROM x_live JOIN x_users USING (user_id) WHERE preferred_category IS NOT NULL) GROUP BY 1, 2),
  offk AS (SELECT example_id, name, v / sum(v) OVER (PARTITION BY example_id) AS weight FROM (
          SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY round(v, 12) DESC, name) AS rn FROM off) WHERE rn <= 5)
  SELECT coalesce(a.example_id, b.example_id) AS user_id, coalesce(a.name, b.name) AS category, round(b.weight, 9) AS without_decay, round(a.weight, 9) AS with_decay
  FROM x_livecat a FULL JOIN offk b ON a.example_id = b.example_id AND a.name = b.name""")
def _(t):
    users, cat = catalog.users(t), catalog.denormalise(t)
    ex = features.live_examples(users)

    def arm(on):
        hist = history.live_history(history.signals(t.events), Recency(enabled=on), features.latest_time(t.events))
        return affinity.category_affinity(hist, cat, ex, users, P)

    on, off = arm(True).select("example_id", "name", F.col("weight").alias("with_decay")), arm(False).select("example_id", "name", F.col("weight").alias("without_decay"))
    return on.join(off, ["example_id", "name"], "full").select(F.col("example_id").alias("user_id"), F.col("name").alias("category"),
                                                               r("without_decay", 9).alias("without_decay"), r("with_decay", 9).alias("with_decay"))
