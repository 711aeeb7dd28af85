"""Leave-one-out and temporal training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import vectors
from shelfwise.operators import affinity, loo, prefixes, temporal, temporal_examples
from shelfwise.params import DEFAULTS
from shelfwise.plans import evaluate, examples, features
from shelfwise.registry.core import long, query, r
from shelfwise.registry.ctes import CTES, counts as counts_sql, history as history_sql, price_profile, user_vector, affinity as affinity_sql
from shelfwise.sources.bindings import EMBEDDING_DIM

P = DEFAULTS

CTES["x_loopair"] = "SELECT DISTINCT user_id, product_id FROM x_log WHERE action_type = 'PURCHASE'"
CTES["x_loorole"] = """
  SELECT user_id, product_id, CASE WHEN n >= 3 AND rn = 1 THEN 'test' WHEN n >= 3 AND rn = 2 THEN 'val' ELSE 'train' END AS role FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || user_id || ':' || product_id), product_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM x_loopair)"""
CTES["x_looex"] = """
  SELECT user_id * 1000000 + product_id AS example_id, user_id, product_id FROM x_loorole WHERE role = 'train'
  UNION ALL SELECT DISTINCT -user_id - 1, user_id, NULL::BIGINT FROM x_loorole"""
CTES["x_looexcl"] = """
  SELECT e.example_id, e.user_id, h.product_id FROM x_looex e JOIN x_loorole h ON h.user_id = e.user_id AND h.role <> 'train'
  UNION SELECT example_id, user_id, product_id FROM x_looex WHERE product_id IS NOT NULL"""
CTES["x_loosearch"] = """
  SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 THEN product_id END AS matched, CASE WHEN event_id % 4 = 0 THEN lower('looking for ' || name) END AS term
  FROM x_log LEFT JOIN x_prod USING (product_id) WHERE action_type = 'SEARCH'"""
CTES["x_loosummary"] = """
  SELECT user_id, lower('asked about ' || name) AS summary FROM (SELECT user_id, arg_max(product_id, (action_time, event_id)) AS product_id FROM x_log WHERE action_type = 'CHATBOT' GROUP BY 1) JOIN x_prod USING (product_id)"""
CTES["x_loomention"] = """
  SELECT s.user_id, s.event_id, p.product_id FROM x_loosearch s JOIN x_loopair p USING (user_id) JOIN x_prod n ON n.product_id = p.product_id
  WHERE s.term IS NOT NULL AND contains(s.term, lower(trim(n.name)))"""
CTES["x_loochat"] = """
  SELECT e.example_id, NOT coalesce(bool_or(c.product_id IS NOT NULL OR contains(s.summary, lower(trim(n.name)))), false) AS chat_ok
  FROM x_looex e LEFT JOIN x_looexcl x USING (example_id) LEFT JOIN x_prod n ON n.product_id = x.product_id
  LEFT JOIN (SELECT DISTINCT user_id, product_id FROM x_log WHERE action_type = 'CHATBOT') c ON c.user_id = e.user_id AND c.product_id = x.product_id
  LEFT JOIN x_loosummary s ON s.user_id = e.user_id GROUP BY 1"""
CTES["x_loohist0"] = """
  SELECT e.example_id, e.user_id, l.signal, l.product_id FROM x_looex e JOIN (
    SELECT user_id, signal, product_id FROM x_log WHERE signal <> 'search' UNION ALL SELECT user_id, 'search', matched FROM x_loosearch WHERE matched IS NOT NULL) l USING (user_id)
  JOIN x_loochat k ON k.example_id = e.example_id
  LEFT JOIN x_looexcl x ON x.example_id = e.example_id AND x.product_id = l.product_id
  WHERE CASE WHEN l.signal = 'chatbot' THEN k.chat_ok ELSE x.example_id IS NULL END"""
CTES["x_loohist"] = "SELECT example_id, user_id, signal, product_id, base, 1.0::DOUBLE AS w FROM x_loohist0 JOIN x_weights USING (signal)"
CTES["x_loocat"] = affinity_sql("x_loohist", "x_looex", "category_name")
CTES["x_loobrand"] = affinity_sql("x_loohist", "x_looex", "brand")
CTES["x_loovec"] = user_vector("x_loohist")
CTES["x_looprice"] = price_profile("x_loohist", "x_looex")

CTES["x_train"] = """
  SELECT p.event_id AS example_id, p.user_id, p.product_id, p.action_time AS cutoff FROM x_purch p JOIN x_split s USING (user_id)
  WHERE s.val_cutoff IS NULL OR p.action_time < s.val_cutoff"""
CTES["x_trainhist0"] = """
  SELECT t.example_id, t.user_id, t.cutoff, l.signal, l.product_id, l.action_time FROM x_train t JOIN x_log l ON l.user_id = t.user_id AND l.action_time < t.cutoff"""
CTES["x_trainhist"] = history_sql("x_trainhist0")
CTES["x_traincat"] = affinity_sql("x_trainhist", "x_train", "category_name")
CTES["x_trainbrand"] = affinity_sql("x_trainhist", "x_train", "brand")
CTES["x_trainvec"] = user_vector("x_trainhist")
CTES["x_trainprice"] = price_profile("x_trainhist", "x_train")
CTES["x_traincounts"] = counts_sql("x_trainhist", "x_train")



def labelled(df, ex):
    """Replace example ids by (user, product), -1 for evaluation cases."""
    return df.join(ex.select("example_id", "user_id", F.coalesce("product_id", F.lit(-1).cast("bigint")).alias("own_product")), "example_id")


@query("loo_split", "D19", "SELECT user_id, product_id, role FROM x_loorole")
def _(t):
    return loo.splits(temporal.purchased_pairs(t.events), P.min_distinct_products_for_holdout, P.split_seed)


@query("text_mentions", "B18", "SELECT user_id, event_id AS text_id, product_id FROM x_loomention")
def _(t):
    return examples.leave_one_out(t).mentions


@query("conversation_mentions", "B18", r"""
  WITH turn AS (SELECT conv_id, turn, role, lower(trim(text)) AS t FROM conversations),
  opening AS (SELECT conv_id, turn, w FROM (
    SELECT conv_id, turn, unnest([regexp_extract(t, '^[^ ]+'), regexp_extract(t, '^[^ ]+ [^ ]+')]) AS w FROM turn WHERE role = 'assistant') WHERE w <> '')
  SELECT DISTINCT u.conv_id AS user_id, u.turn AS text_id, o.turn AS product_id FROM turn u JOIN opening o USING (conv_id) WHERE u.role = 'user' AND contains(u.t, o.w)""")
def _(t):
    """Which answers' openings, of one and of two words, stand in the user's own turns of the conversation."""
    said = t.scan("conversations").where("role = 'assistant'").withColumn("t", F.lower(F.trim("text")))
    openings = F.array(F.regexp_extract("t", "^[^ ]+", 0), F.regexp_extract("t", "^[^ ]+ [^ ]+", 0))
    names = said.select(F.col("conv_id").alias("user_id"), F.col("turn").alias("product_id"), F.explode(openings).alias("name"))
    return loo.text_mentions(t.user_turns.withColumnRenamed("turn", "text_id"), names)


@query("loo_usable_searches", "B16", """
  SELECT e.user_id, coalesce(e.product_id, -1) AS own_product, count(s.event_id) FILTER (x.hit IS NULL) AS usable_searches
  FROM x_looex e LEFT JOIN (SELECT * FROM x_loosearch WHERE term IS NOT NULL) s USING (user_id)
  LEFT JOIN (SELECT DISTINCT e.example_id, m.event_id, true AS hit FROM x_looexcl e JOIN x_loomention m USING (user_id, product_id)) x
    ON x.example_id = e.example_id AND x.event_id = s.event_id GROUP BY 1, 2""")
def _(t):
    l = examples.leave_one_out(t)
    return labelled(loo.kept_searches(l.open_searches, l.mentions, l.held, l.examples), l.examples).drop("example_id")


@query("loo_chatbot_usable", "B17", "SELECT e.user_id, coalesce(e.product_id, -1) AS own_product, chat_ok FROM x_loochat JOIN x_looex e USING (example_id)")
def _(t):
    l = examples.leave_one_out(t)
    return labelled(l.usable, l.examples).drop("example_id")


@query("loo_counts", "B14 B15 I4 I5", """
  SELECT e.user_id, coalesce(e.product_id, -1) AS own_product, count(*) FILTER (signal = 'click') AS click_count, count(*) FILTER (signal = 'purchase') AS purchase_count,
         count(DISTINCT h.product_id) FILTER (signal = 'purchase') AS distinct_products_purchased, count(*) FILTER (signal = 'cart') AS cart_item_count,
         any_value(coalesce(n.s, 0)) AS search_count, any_value(n.c) AS has_chatbot_context
  FROM x_looex e LEFT JOIN (SELECT * FROM x_loohist WHERE signal <> 'search') h USING (example_id)
  LEFT JOIN (SELECT user_id, count(*) FILTER (signal = 'search') AS s, count(*) FILTER (signal = 'chatbot') > 0 AS c FROM x_log GROUP BY 1) n ON n.user_id = e.user_id GROUP BY 1, 2""")
def _(t):
    l = examples.leave_one_out(t)
    c = loo.example_counts(l.counts, t.searches, l.counts.where("signal = 'chatbot'"), l.held, l.examples).drop("user_id", "total_engagement_events")
    return labelled(c, l.examples).drop("example_id")


@query("loo_category_affinity", "I4 I5 B14 B15 B17", "SELECT e.user_id, coalesce(e.product_id, -1) AS own_product, name, round(weight, 9) AS weight, rank FROM x_loocat JOIN x_looex e USING (example_id)")
def _(t):
    l, cat = examples.leave_one_out(t), features.build_catalog(t)
    a = affinity.as_rows(examples.loo_categories(l, cat))
    return labelled(a, l.examples).select("user_id", "own_product", "name", r("weight", 9).alias("weight"), long("rank").alias("rank"))


@query("loo_features", "I4 I5 D7 D12", """
  SELECT e.user_id, coalesce(e.product_id, -1) AS own_product, round(p.typical_price, 6) AS typical_price, round(p.price_spread, 3) AS price_spread, p.supporting_purchase_count,
         coalesce(b.n, 0) AS brands, round(v.v, 6) AS vector_first, round(v.sq, 6) AS vector_square
  FROM x_looex e JOIN x_looprice p ON p.example_id = e.example_id LEFT JOIN (SELECT example_id, count(*) AS n FROM x_loobrand GROUP BY 1) b ON b.example_id = e.example_id
  LEFT JOIN (SELECT example_id, sum(v) FILTER (pos = 0) AS v, sum(v * v) AS sq FROM x_loovec GROUP BY 1) v ON v.example_id = e.example_id""")
def _(t):
    l, cat = examples.leave_one_out(t), features.build_catalog(t)
    f = examples.loo_features(t, l, cat).drop("user_id")
    return labelled(f, l.examples).select(
        "user_id", "own_product", r("typical_price").alias("typical_price"), r("price_spread", 3).alias("price_spread"), "supporting_purchase_count",
        long(F.size("brand_affinity")).alias("brands"), r(F.col("vector")[0]).alias("vector_first"), r(vectors.dot(F.col("vector"), F.col("vector"))).alias("vector_square"))


def _temporal(t):
    cat = features.build_catalog(t, popularity=False)
    split = evaluate.stage(temporal.splits(t.events, t.users), "splits")
    return cat, examples.temporal_training(t, split, cat)


@query("temporal_train_counts", "I6 C10", """
  SELECT example_id, user_id, click_count, purchase_count, distinct_products_purchased, cart_item_count, search_count, has_chatbot_context, total_engagement_events FROM x_traincounts""")
def _(t):
    return temporal_examples.counts(_temporal(t)[1].base)


@query("temporal_train_affinity", "I6 D8 D10", "SELECT example_id, name, round(weight, 6) AS weight, rank FROM x_traincat")
def _(t):
    cat, te = _temporal(t)
    a = affinity.top_normalised(examples.temporal_category_contributions(te, cat), P.features.max_top_categories)
    return a.select("example_id", "name", r("weight").alias("weight"), long("rank").alias("rank"))


@query("temporal_train_vectors", "I6 D11 D12", "SELECT example_id, pos, round(v, 6) AS value FROM x_trainvec")
def _(t):
    _, te = _temporal(t)
    chat = temporal_examples.chatbot_factors(te.base, te.examples, P.features.recency)
    v = prefixes.user_vectors(te.log, te.examples, chat, t.embeddings, P.features, EMBEDDING_DIM)
    return v.select("example_id", F.posexplode("vector").alias("pos", "value")).withColumn("pos", long("pos")).withColumn("value", r("value"))


@query("temporal_train_features", "I6 D7 D9", """
  SELECT t.example_id, t.product_id, round(p.typical_price, 6) AS typical_price, round(p.price_spread, 3) AS price_spread, p.fallback_source, round(b.weight, 6) AS top_brand_weight, b.name AS top_brand
  FROM x_train t JOIN x_trainprice p USING (example_id) LEFT JOIN (SELECT * FROM x_trainbrand WHERE rank = 1) b USING (example_id)""")
def _(t):
    cat, te = _temporal(t)
    f = examples.temporal_features(t, te, cat).join(te.examples.select("example_id", "product_id"), "example_id")
    best = F.array_max(F.transform(F.map_entries("brand_affinity"), lambda e: F.struct(F.round(e["value"], 12).alias("w"), e["value"].alias("v"))))
    top = F.try_element_at(F.array_sort(F.transform(F.filter(F.map_entries("brand_affinity"), lambda e: F.round(e["value"], 12) == best["w"]), lambda e: e["key"])), F.lit(1))
    return f.select("example_id", "product_id", r("typical_price").alias("typical_price"), r("price_spread", 3).alias("price_spread"), "fallback_source",
                    r(best["v"]).alias("top_brand_weight"), top.alias("top_brand"))


@query("first_example_users", "E11", """
  SELECT label, min(user_id) AS user_id FROM (
    SELECT unnest([CASE WHEN tier = 'FULL' AND total_purchases >= 5 THEN 'many_purchases' END, CASE WHEN tier = 'NO_HISTORY' THEN 'no_history' END,
                   CASE WHEN tier = 'INSUFFICIENT_DEPTH' THEN 'one_purchase' END, CASE WHEN tier = 'FULL' THEN 'full' END]) AS label, user_id FROM x_split) WHERE label IS NOT NULL GROUP BY 1""")
def _(t):
    s = temporal.splits(t.events, t.users)
    labels = F.array_compact(F.array(
        F.when((F.col("tier") == "FULL") & (F.col("total_purchases") >= 5), "many_purchases"), F.when(F.col("tier") == "NO_HISTORY", "no_history"),
        F.when(F.col("tier") == "INSUFFICIENT_DEPTH", "one_purchase"), F.when(F.col("tier") == "FULL", "full")))
    return s.select("user_id", F.explode(labels).alias("label")).groupBy("label").agg(F.min("user_id").alias("user_id"))
