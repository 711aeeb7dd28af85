"""Encoders, ranking rows, models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from shelfwise.functions import vectors
from shelfwise.operators import catalog, encode, metrics, ranking, retrieval, temporal
from shelfwise.operators.perceptron import Perceptron
from shelfwise.operators.textvec import fit_hashing_encoder
from shelfwise.params import DEFAULTS
from shelfwise.plans import evaluate, examples, features, ranker, serve
from shelfwise.registry.core import long, query, r
from shelfwise.registry.ctes import CTES
from shelfwise.registry.temporal_queries import KS, long_metrics, metric_sql
from shelfwise.sources.bindings import EMBEDDING_DIM
from shelfwise.sources.stage import stage

P = DEFAULTS
POOL = 50

for _tag, _ex in (("train", "x_train"),):
    CTES[f"x_{_tag}vecs"] = f"SELECT example_id, list(v ORDER BY pos) AS vec FROM x_{_tag}vec GROUP BY 1"
    CTES[f"x_{_tag}tier"] = (
        f"SELECT *, CASE WHEN typical_price <= tier_lower THEN 'budget' WHEN typical_price <= tier_upper THEN 'mid' ELSE 'premium' END AS price_tier FROM x_{_tag}price")
CTES["x_loovecs"] = "SELECT example_id, list(v ORDER BY pos) AS vec FROM x_loovec GROUP BY 1"
CTES["x_lootier"] = "SELECT *, CASE WHEN typical_price <= tier_lower THEN 'budget' WHEN typical_price <= tier_upper THEN 'mid' ELSE 'premium' END AS price_tier FROM x_looprice"
CTES["x_loocounts"] = """
  SELECT e.example_id, e.user_id, count(*) FILTER (signal = 'purchase') AS purchase_count, count(*) FILTER (signal = 'cart') AS cart_item_count,
         any_value(coalesce(n.s, 0)) AS search_count, any_value(coalesce(n.c, false)) AS has_chatbot_context,
         count(*) FILTER (signal IN ('click', 'purchase', 'cart')) + any_value(coalesce(n.s, 0)) + any_value(coalesce(n.c, false)::INT) AS total_engagement_events
  FROM x_looex e LEFT JOIN (SELECT * FROM x_loohist WHERE signal <> 'search') h USING (example_id)
  LEFT JOIN (SELECT user_id, count(*) FILTER (signal = 'search') AS s, count(*) FILTER (signal = 'chatbot') > 0 AS c FROM x_log GROUP BY 1) n ON n.user_id = e.user_id GROUP BY 1, 2"""
# popularity is not part of the temporal protocol's item features
CTES["x_pf0"] = """
  SELECT * REPLACE (0::BIGINT AS purchase_count, 0::BIGINT AS distinct_purchasers, 0::BIGINT AS cart_add_count, 0::BIGINT AS review_count, NULL::DOUBLE AS average_rating) FROM x_pf"""


def digits(name: str) -> int:
    """Shares of small counts end exactly between two 6-digit values too often."""
    return 9 if name.endswith("affinity_match") else 6


def hits_sql(vecs: str, k: int, where: str = "true") -> str:
    return f"""
  SELECT * FROM (SELECT v.example_id, e.product_id, list_cosine_similarity(v.vec, e.vec) AS score,
    row_number() OVER (PARTITION BY v.example_id ORDER BY list_cosine_similarity(v.vec, e.vec) DESC, e.product_id) AS rank
    FROM {vecs} v CROSS JOIN x_vecs e WHERE {where}) WHERE rank <= {k}"""


def feature_sql(cand: str, tag: str, pf: str, keys: str, counts: str, price: str) -> str:
    """All 29 features of the rows in `cand` (example_id, product_id, retrieval_score, retrieval_rank)."""
    parts = {
        "user_log_purchase_count": "ln(1 + c.purchase_count)", "user_log_cart_item_count": "ln(1 + c.cart_item_count)", "user_log_search_count": "ln(1 + c.search_count)",
        "user_log_total_engagement_events": "ln(1 + c.total_engagement_events)", "user_has_chatbot_context": "c.has_chatbot_context::INT",
        "user_has_preferred_category": "(u.preferred_category IS NOT NULL)::INT", "user_has_age_group": "(u.age_group IS NOT NULL)::INT",
        "item_normalized_price": "least(p.effective_price / b.max_price, 1)", "item_discount_fraction": "coalesce(p.discount_percentage, 0) / 100",
        "item_log_purchase_count": "ln(1 + p.purchase_count)", "item_log_cart_add_count": "ln(1 + p.cart_add_count)", "item_log_review_count": "ln(1 + p.review_count)",
        "item_average_rating": "coalesce(p.average_rating, 0)", "item_has_rating": "(p.average_rating IS NOT NULL)::INT", "item_log_stock_quantity": "ln(1 + p.stock_quantity)",
        "item_is_active": "p.is_active::INT", "item_category_relative_price": "p.category_relative_price", "item_is_discounted": "p.is_discounted::INT",
        "category_affinity_match": "coalesce(a.weight, 0)", "brand_affinity_match": "coalesce(br.weight, 0)",
        "preferred_category_match": "coalesce(u.preferred_category = p.category_name, false)::INT",
        "semantic_cosine_similarity": "coalesce(list_cosine_similarity(v.vec, e.vec), 0)", "has_semantic_similarity": "(v.vec IS NOT NULL AND e.vec IS NOT NULL)::INT",
        "user_normalized_typical_price": "least(pp.typical_price / b.max_price, 1)", "user_has_price_profile": "1",
        "price_relative_distance": "abs(p.effective_price - pp.typical_price) / greatest(pp.typical_price, 1e-6)", "price_tier_match": "(pp.price_tier = p.price_tier)::INT",
        "retrieval_score": "k.retrieval_score", "retrieval_rank_normalized": f"k.retrieval_rank / {float(POOL - 1)}::DOUBLE"}
    cols = ", ".join(f"round(({e})::DOUBLE, {digits(n)}) AS {n}" for n, e in parts.items())
    return f"""
  SELECT {keys}, {cols} FROM {cand} k JOIN {counts} c ON c.example_id = k.example_id JOIN {pf} p ON p.product_id = k.product_id
  CROSS JOIN (SELECT max_price FROM x_bounds) b LEFT JOIN x_users u ON u.user_id = c.user_id JOIN {price} pp ON pp.example_id = k.example_id
  LEFT JOIN x_{tag}cat a ON a.example_id = k.example_id AND a.name = p.category_name LEFT JOIN x_{tag}brand br ON br.example_id = k.example_id AND br.name = p.brand
  LEFT JOIN x_{tag}vecs v ON v.example_id = k.example_id LEFT JOIN x_vecs e ON e.product_id = k.product_id"""


def rounded_features(df, *keys):
    return df.select(*keys, *[r(n, digits(n)).alias(n) for n in ranking.FEATURES])


# --- encoders ------------------------------------------------------------------------------------
@query("vocabularies", "D15 D16", """
  SELECT vocab, value, row_number() OVER (PARTITION BY vocab ORDER BY value) AS idx FROM (
    SELECT DISTINCT 'category' AS vocab, category_name AS value FROM x_catalog WHERE category_name <> '' UNION SELECT DISTINCT 'brand', brand FROM x_catalog WHERE brand <> ''
    UNION SELECT DISTINCT 'age_group', age_group FROM x_users WHERE age_group <> '' UNION SELECT 'max_price', max(price)::DECIMAL(12, 2)::VARCHAR FROM x_catalog)""")
def _(t):
    cat, users = catalog.denormalise(t), catalog.users(t)
    out = None
    for name, df, col in (("category", cat, "category_name"), ("brand", cat, "brand"), ("age_group", users, "age_group")):
        v = encode.vocabulary(df, col).select(F.lit(name).alias("vocab"), "value", "idx")
        out = v if out is None else out.unionByName(v)
    top = t.products.agg(F.max("price").cast("decimal(12,2)").cast("string").alias("value"))
    return out.unionByName(top.select(F.lit("max_price").alias("vocab"), "value", F.lit(1).cast("bigint").alias("idx")))


@query("encoded_items", "I1 H11 H12", """
  WITH cv AS (SELECT category_name AS value, row_number() OVER (ORDER BY category_name) AS idx FROM (SELECT DISTINCT category_name FROM x_catalog WHERE category_name IS NOT NULL)),
       bv AS (SELECT brand AS value, row_number() OVER (ORDER BY brand) AS idx FROM (SELECT DISTINCT brand FROM x_catalog WHERE brand IS NOT NULL))
  SELECT p.product_id, coalesce(cv.idx, 0) AS category_id_enc, coalesce(bv.idx, 0) AS brand_id_enc, CASE price_tier WHEN 'budget' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END::BIGINT AS price_tier_id_enc,
         round(least(effective_price / max_price, 1.0::DOUBLE), 6) AS normalized_price, round(coalesce(discount_percentage, 0) / 100, 6) AS discount_fraction,
         round(ln(1 + purchase_count), 6) AS log_purchase_count, round(ln(1 + cart_add_count), 6) AS log_cart_add_count, round(ln(1 + review_count), 6) AS log_review_count,
         round(coalesce(average_rating, 0), 6) AS average_rating, (average_rating IS NOT NULL)::INT::DOUBLE AS has_rating, round(category_relative_price, 6) AS category_relative_price,
         is_discounted::INT::DOUBLE AS is_discounted, round(list_sum(e.vec), 6) AS vector_sum
  FROM x_pf p JOIN x_vecs e USING (product_id) CROSS JOIN (SELECT max_price FROM x_bounds) LEFT JOIN cv ON cv.value = category_name LEFT JOIN bv ON bv.value = brand""")
def _(t):
    f = stage(catalog.product_features(t, t.events), "product_features")
    e = encode.encode_items(f, t.embeddings, encode.vocabulary(f, "category_name"), encode.vocabulary(f, "brand"), encode.tier_vocabulary(t.spark))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    cols = [c for c in e.columns if c != "embedding"]
    return e.select(*[r(c).alias(c) if dict(e.dtypes)[c] == "double" else F.col(c) for c in cols], r(total).alias("vector_sum"))


def _encoded_users(t):
    cat = features.build_catalog(t)
    f = features.live_user_features(t, cat)
    return encode.encode_users(f, encode.vocabulary(cat.features, "category_name"), encode.vocabulary(cat.features, "brand"), encode.vocabulary(cat.users, "age_group"),
                               encode.tier_vocabulary(t.spark), cat.context.select("max_price").scalar(), EMBEDDING_DIM)


@query("encoded_users", "I2", """
  WITH cv AS (SELECT category_name AS value, row_number() OVER (ORDER BY category_name) AS idx FROM (SELECT DISTINCT category_name FROM x_catalog WHERE category_name IS NOT NULL)),
       av AS (SELECT age_group AS value, row_number() OVER (ORDER BY age_group) AS idx FROM (SELECT DISTINCT age_group FROM x_users))
  SELECT c.user_id, coalesce(cv.idx, 0) AS preferred_category_id_enc, coalesce(av.idx, 0) AS age_group_id_enc, CASE price_tier WHEN 'budget' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END::BIGINT AS price_tier_id_enc,
         round(ln(1 + purchase_count), 6) AS log_purchase_count, round(ln(1 + total_engagement_events), 6) AS log_total_engagement_events, has_chatbot_context::INT::DOUBLE AS has_chatbot_context,
         (v.vec IS NOT NULL)::INT::DOUBLE AS has_semantic_embedding, round(least(typical_price / max_price, 1.0::DOUBLE), 6) AS normalized_typical_price,
         round(coalesce(list_sum(v.vec), 0), 6) AS vector_sum
  FROM x_livecounts c JOIN x_liveprice p USING (user_id) JOIN x_users u USING (user_id) CROSS JOIN (SELECT max_price FROM x_bounds)
  LEFT JOIN x_livevecs v ON v.example_id = c.user_id LEFT JOIN cv ON cv.value = u.preferred_category LEFT JOIN av ON av.value = u.age_group""")
def _(t):
    e = _encoded_users(t)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return e.select("user_id", "preferred_category_id_enc", "age_group_id_enc", "price_tier_id_enc", r("log_purchase_count").alias("log_purchase_count"),
                    r("log_total_engagement_events").alias("log_total_engagement_events"), "has_chatbot_context", "has_semantic_embedding",
                    r("normalized_typical_price").alias("normalized_typical_price"), r(total).alias("vector_sum"))


@query("dense_affinities", "H15 H16 I2", """
  WITH cv AS (SELECT category_name AS value, row_number() OVER (ORDER BY category_name) - 1 AS slot FROM (SELECT DISTINCT category_name FROM x_catalog WHERE category_name IS NOT NULL)),
       bv AS (SELECT brand AS value, row_number() OVER (ORDER BY brand) - 1 AS slot FROM (SELECT DISTINCT brand FROM x_catalog WHERE brand IS NOT NULL))
  SELECT example_id AS user_id, 'category' AS kind, slot, round(weight, 6) AS weight FROM x_livecat JOIN cv ON value = name
  UNION ALL SELECT example_id, 'brand', slot, round(weight, 6) FROM x_livebrand JOIN bv ON value = name""")
def _(t):
    e = _encoded_users(t)
    parts = [e.select("user_id", F.lit(k).alias("kind"), F.posexplode(c).alias("slot", "weight")).where("weight > 0") for k, c in (("category", "category_affinity"), ("brand", "brand_affinity"))]
    return parts[0].unionByName(parts[1]).select("user_id", "kind", long("slot").alias("slot"), r("weight").alias("weight"))


# --- ranking rows --------------------------------------------------------------------------------
CTES["x_rankcand"] = f"SELECT v.example_id, v.product_id, v.score AS retrieval_score, v.rank - 1 AS retrieval_rank FROM ({hits_sql('x_livevecs', POOL, 'e.product_id IN (SELECT product_id FROM x_pf WHERE eligible)')}) v"


@query("ranking_features", "I3 C16 H13 H15", feature_sql("x_rankcand", "live", "x_pf", "k.example_id, k.product_id", "x_livecounts", "x_liveprice"))
def _(t):
    cat = features.build_catalog(t)
    f = stage(features.live_user_features(t, cat), "user_features")
    own = serve.personalised(f, cat, t.embeddings, POOL, P)
    cand = own.select("example_id", "product_id", F.col("score").alias("retrieval_score"), (F.col("position") - 1).alias("retrieval_rank"))
    return rounded_features(ranking.feature_rows(cand, f, cat.features, t.embeddings, POOL), "example_id", "product_id")


CTES["x_trainhits"] = hits_sql("x_trainvecs", POOL)
CTES["x_trainneg"] = """
  SELECT example_id, user_id, product_id, retrieval_score, retrieval_rank FROM (
    SELECT h.example_id, t.user_id, h.product_id, h.score AS retrieval_score, h.rank - 1 AS retrieval_rank,
           row_number() OVER (PARTITION BY h.example_id ORDER BY md5('42:' || t.user_id || ':' || t.product_id || ':' || h.product_id), h.product_id) AS pick
    FROM x_trainhits h JOIN x_train t USING (example_id)
    WHERE NOT EXISTS (SELECT 1 FROM x_log l WHERE l.action_type = 'PURCHASE' AND l.user_id = t.user_id AND l.product_id = h.product_id)) WHERE pick <= 4"""
CTES["x_trainpos"] = """
  SELECT t.example_id, t.user_id, t.product_id, coalesce(h.score, w.worst, 0) AS retrieval_score, coalesce(h.rank - 1, w.n, 0) AS retrieval_rank
  FROM x_train t LEFT JOIN x_trainhits h USING (example_id, product_id) LEFT JOIN (SELECT example_id, min(score) AS worst, count(*) AS n FROM x_trainhits GROUP BY 1) w ON w.example_id = t.example_id"""
CTES["x_trainrows"] = "SELECT 1::BIGINT AS label, * FROM x_trainpos UNION ALL SELECT 0::BIGINT, * FROM x_trainneg"


def temporal_ranking_rows(t):
    cat = features.build_catalog(t, popularity=False)
    tc = evaluate.temporal_cases(t)
    te = examples.temporal_training(t, tc.split, cat)
    f = examples.temporal_features(t, te, cat)
    feats = evaluate.case_features(t, tc, cat)
    rows = ranker.temporal_rows(f, te.examples, feats, tc.cases, tc.target, temporal.purchased_pairs(t.events), t, cat, POOL)
    return cat, tc, feats, stage(rows, "ranking_rows")


@query("sampled_negatives", "I9 C18 G4 E9", """
  SELECT label, example_id, user_id, product_id, round(retrieval_score, 6) AS retrieval_score, retrieval_rank FROM x_trainrows""")
def _(t):
    cat = features.build_catalog(t, popularity=False)
    split = stage(temporal.splits(t.events, t.users), "splits")
    te = examples.temporal_training(t, split, cat)
    f = stage(examples.temporal_features(t, te, cat), "train_features")
    hits = stage(ranker._search(f, t.embeddings, POOL, P), "hits")
    ex = te.examples.select("example_id", "user_id", "product_id")
    pos = ranking.score_and_rank(ex, hits).select(F.lit(1).cast("bigint").alias("label"), "example_id", "user_id", "product_id", "retrieval_score", "retrieval_rank")
    wanted = ex.select("example_id", "user_id", F.col("product_id").alias("salt"), F.lit(4).alias("needed"))
    neg = ranking.retrieved_negatives(hits, wanted, temporal.purchased_pairs(t.events), P.ranking.random_seed)
    rows = pos.unionByName(neg.select(F.lit(0).cast("bigint").alias("label"), "example_id", "user_id", "product_id", "retrieval_score", "retrieval_rank"))
    return rows.withColumn("retrieval_score", r("retrieval_score"))


@query("temporal_ranking_rows", "I8", feature_sql("x_trainrows", "train", "x_pf0", "k.example_id, k.product_id, k.label", "x_traincounts", "x_traintier"))
def _(t):
    rows = temporal_ranking_rows(t)[3].where("split = 'train'")
    return rounded_features(rows, "example_id", "product_id", long("label").alias("label"))


CTES["x_loohits"] = hits_sql("x_loovecs", POOL)
CTES["x_loorows"] = """
  SELECT 'train' AS split, 1::BIGINT AS label, e.example_id, e.user_id, e.product_id FROM x_looex e WHERE e.product_id IS NOT NULL
  UNION ALL SELECT 'val', 1, e.example_id, e.user_id, v.product_id FROM x_looex e JOIN x_loorole v ON v.user_id = e.user_id AND v.role = 'val' WHERE e.product_id IS NULL
  UNION ALL SELECT split, 0, example_id, user_id, product_id FROM (
    SELECT s.split, h.example_id, e.user_id, h.product_id, s.needed,
           row_number() OVER (PARTITION BY h.example_id, s.split ORDER BY md5('42:' || e.user_id || ':' || s.salt || ':' || h.product_id), h.product_id) AS pick
    FROM x_loohits h JOIN x_looex e USING (example_id)
    JOIN (SELECT user_id, 'train' AS split, 0 AS salt, 4 * count(*) AS needed FROM x_loorole WHERE role = 'train' GROUP BY 1
          UNION ALL SELECT user_id, 'val', 1, 4 FROM x_loorole WHERE role = 'test') s ON s.user_id = e.user_id
    WHERE e.product_id IS NULL AND NOT EXISTS (SELECT 1 FROM x_loopair l WHERE l.user_id = e.user_id AND l.product_id = h.product_id)) WHERE pick <= needed"""
CTES["x_loocand"] = """
  SELECT w.*, coalesce(h.score, m.worst, 0) AS retrieval_score, coalesce(h.rank - 1, m.n, 0) AS retrieval_rank FROM x_loorows w
  LEFT JOIN x_loohits h ON h.example_id = w.example_id AND h.product_id = w.product_id
  LEFT JOIN (SELECT example_id, min(score) AS worst, count(*) AS n FROM x_loohits GROUP BY 1) m ON m.example_id = w.example_id"""


def loo_ranking(t):
    cat = features.build_catalog(t)
    l = examples.leave_one_out(t)
    f = stage(examples.loo_features(t, l, cat), "loo_features")
    return cat, l, f


@query("loo_ranking_rows", "I7", feature_sql("x_loocand", "loo", "x_pf", "k.user_id, k.product_id, k.label, k.split", "x_loocounts", "x_lootier"))
def _(t):
    cat, l, f = loo_ranking(t)
    rows = ranker.leave_one_out_rows(f, l.examples, l.roles, t, cat, POOL)
    return rounded_features(rows, "user_id", "product_id", long("label").alias("label"), "split")


CTES["x_looevalrank"] = "SELECT h.example_id AS case_id, h.rank, h.product_id AS item_id FROM x_loohits h JOIN x_looex e USING (example_id) WHERE e.product_id IS NULL"
CTES["x_looevalrel"] = "SELECT -user_id - 1 AS case_id, product_id AS item_id FROM x_loorole WHERE role = 'test'"
_EVAL_CASES = "(SELECT -user_id - 1 AS case_id, 'test' AS split FROM x_loorole WHERE role = 'test')"


def loo_eval(t, f, l):
    cases = l.examples.where("evaluable").select(F.col("example_id").alias("case_id"), "user_id", F.lit("test").alias("split"))
    relevant = cases.select("case_id", "user_id").join(l.roles.where("role = 'test'").select("user_id", F.col("product_id").alias("item_id")), "user_id").drop("user_id")
    return cases.drop("user_id"), relevant


@query("loo_retrieval_order_metrics", "J5 J6", metric_sql("x_looevalrank", cases=_EVAL_CASES, relevant="x_looevalrel"))
def _(t):
    cat, l, f = loo_ranking(t)
    cases, relevant = loo_eval(t, f, l)
    hits = ranker._search(f.where("example_id < 0"), t.embeddings, POOL, P)
    return long_metrics(evaluate.evaluate_lists(hits.withColumnRenamed("query_id", "case_id"), relevant, cases, KS, ["split"]))


@query("in_batch_softmax", "D42", """
  WITH rows AS (SELECT t.example_id AS row_id, ('0x' || substr(md5(t.example_id::VARCHAR), 1, 8))::BIGINT % (SELECT ceil(count(*) / 64.0)::BIGINT FROM x_train JOIN x_trainvecs USING (example_id)) AS batch, v.vec AS u, e.vec AS i
                FROM x_train t JOIN x_trainvecs v USING (example_id) JOIN x_vecs e USING (product_id)),
  logits AS (SELECT a.row_id, a.batch, b.row_id AS other, list_cosine_similarity(a.u, b.i) / 0.05::DOUBLE AS x FROM rows a JOIN rows b USING (batch))
  SELECT row_id, batch, round(max(x) + ln(sum(exp(x - m))) - max(x) FILTER (row_id = other), 6) AS loss, arg_max(other, (round(x, 9), -other)) = row_id AS hit
  FROM (SELECT *, max(x) OVER (PARTITION BY row_id) AS m FROM logits) GROUP BY 1, 2""")
def _(t):
    cat = features.build_catalog(t, popularity=False)
    split = stage(temporal.splits(t.events, t.users), "splits")
    te = examples.temporal_training(t, split, cat)
    f = stage(examples.temporal_features(t, te, cat).where("vector IS NOT NULL").select("example_id", "vector"), "train_vectors")
    pairs = te.examples.join(f, "example_id").join(t.embeddings, "product_id").select(F.col("example_id").alias("row_id"), F.col("vector").alias("user_vector"), F.col("embedding").alias("item_vector"))
    out = encode.in_batch_softmax(pairs, math.ceil(f.count() / 64), P.temperature)
    return out.withColumn("loss", r("loss"))


# --- a model with fixed weights, which SQL repeats -------------------------------------------------
_INPUTS = ("effective_price", "purchase_count", "cart_add_count", "category_relative_price")
FIXED_MODEL = Perceptron((1000.0, 1.0, 1.0, 0.5), (0.002, 0.75, 0.5, 3.0),
                         ((((0.5, 1.0, -0.25, 0.125), (-0.75, 0.25, 0.5, 1.5), (0.25, -0.5, 1.0, -1.0)), (0.1, -0.2, 0.3)), (((1.0, -0.5, 0.25), (-0.75, 1.25, 0.5)), (0.05, -0.05))))


def perceptron_sql(model, inputs):
    """The score as SQL arithmetic over the named columns."""
    x = [f"((coalesce({c}, 0)::DOUBLE - {m!r}) * {s!r})" for c, m, s in zip(inputs, model.mean, model.scale)]
    for n, (weights, biases) in enumerate(model.layers):
        z = [" + ".join([f"{w!r} * {v}" for w, v in zip(row, x)] + [repr(b)]) for row, b in zip(weights, biases)]
        x = [f"(1 / (1 + exp(-({t}))))" for t in z] if n + 1 < len(model.layers) else [f"({t})" for t in z]
    return f"1 / (1 + exp({x[0]} - {x[1]}))"


CTES["x_fixedmodel"] = f"SELECT product_id, category_name, eligible, {perceptron_sql(FIXED_MODEL, _INPUTS)} AS p FROM x_pf"


def fixed_model_scores(t):
    """Products with the fixed model's score `p`, staged for the rankings below."""
    f = catalog.product_features(t, t.events)
    return stage(f.select("product_id", "category_name", "eligible", FIXED_MODEL.score([F.coalesce(F.col(c), F.lit(0)) for c in _INPUTS]).alias("p")), "fixed_scores")


@query("fixed_model_order", "E8 J2", """
  SELECT query_id, item_id, position, round(p, 6) AS model_score FROM (
    SELECT category_name AS query_id, product_id AS item_id, p, row_number() OVER (PARTITION BY category_name ORDER BY p DESC, product_id) AS position FROM x_fixedmodel WHERE category_name IS NOT NULL)""")
def _(t):
    scored = fixed_model_scores(t).where("category_name IS NOT NULL").select(F.col("category_name").alias("query_id"), F.col("product_id").alias("item_id"), F.col("product_id").alias("rank"), F.col("p").alias("model_score"))
    return ranking.order_by_model(scored).select("query_id", "item_id", long("position").alias("position"), r("model_score").alias("model_score"))


@query("fixed_model_auc", "I11", """
  WITH ranked AS (SELECT eligible, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS place FROM x_fixedmodel),
  sums AS (SELECT sum(place) FILTER (eligible) AS s, count(*) FILTER (eligible) AS p, count(*) FILTER (NOT eligible) AS n FROM ranked)
  SELECT round((s - p * (p + 1) / 2.0) / (p * n), 6) AS auc, p AS positives, n AS negatives FROM sums""")
def _(t):
    got = metrics.auc(fixed_model_scores(t).withColumn("label", F.col("eligible").cast("int")), "p", "label")
    return got.select(r("auc").alias("auc"), long("positives").alias("positives"), long("negatives").alias("negatives"))


# --- models: no SQL form, invariants are tested ---------------------------------------------------
@query("ranker_quality", "I10 I11")
def _(t):
    _, _, _, rows = temporal_ranking_rows(t)
    out = []
    for name, baseline in (("perceptron", False), ("logistic", True)):
        model = ranker.fit_ranker(rows.where("split = 'train'"), P.ranking, baseline)
        q = ranker.ranker_quality(model, rows.where("split = 'val'"))
        out += [(name, k, float(v)) for k, v in q.items()]
    return t.spark.createDataFrame(out, "model string, metric string, value double")


@query("model_vs_retrieval_order", "J6 E8 J2")
def _(t):
    cat, l, f = loo_ranking(t)
    rows = stage(ranker.leave_one_out_rows(f, l.examples, l.roles, t, cat, POOL), "loo_rows")
    model = ranker.fit_ranker(rows.where("split = 'train'"))
    users = f.where("example_id < 0")
    hits = stage(ranker._search(users, t.embeddings, POOL, P), "hits")
    cases, relevant = loo_eval(t, f, l)
    ranked = ranking.order_by_model(ranker.model_scorer(model, users, cat, t.embeddings, POOL)(hits)).select(F.col("query_id").alias("case_id"), F.col("position").alias("rank"), "item_id")
    arms = {"retrieval": hits.withColumnRenamed("query_id", "case_id"), "model": ranked}
    out = [evaluate.evaluate_lists(df, relevant, cases, KS, ["split"]).withColumn("arm", F.lit(n)) for n, df in arms.items()]
    return long_metrics(out[0].unionByName(out[1]))


def served_with_model(t):
    cat, tc, feats, rows = temporal_ranking_rows(t)
    model = ranker.fit_ranker(rows.where("split = 'train'"))
    scorer = ranker.model_scorer(model, feats, cat, t.embeddings, POOL)
    return evaluate.evaluate_recommendations(t, P, 10, scorer, tc, cat, feats)


@query("model_served_metrics", "J2 J8 J10")
def _(t):
    tc, _, rec = served_with_model(t)
    return long_metrics(evaluate.evaluate_lists(evaluate.as_ranked(rec.items), tc.relevant, tc.ids, KS, ["split"]))


@query("interaction_factor_recall", "I12")
def _(t):
    tc = evaluate.temporal_cases(t)
    first = t.events.join(tc.split.select("user_id", "val_cutoff"), "user_id", "left").where("val_cutoff IS NULL OR action_time < val_cutoff")
    users, items = ranker.interaction_factors(first)
    hits = retrieval.exact_topk(tc.cases.select(F.col("example_id").alias("query_id"), "user_id").join(users, "user_id"), items, 20, P.retrieval)
    return long_metrics(evaluate.evaluate_lists(hits.withColumnRenamed("query_id", "case_id"), tc.relevant, tc.ids, KS, ["split"]))


@query("approximate_search_recall", "F2 F4")
def _(t):
    q = t.embeddings.select(F.col("product_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = q.withColumnRenamed("query_id", "item_id")
    exact = stage(retrieval.exact_topk(q, items, 50, P.retrieval), "exact")
    near = stage(retrieval.cell_topk(q, items, 50, P.retrieval), "near")
    out = None
    for k in (10, 20, 50):
        rel = exact.where(F.col("rank") <= k).select(F.col("query_id").alias("case_id"), "item_id")
        m = metrics.case_metrics(near.withColumnRenamed("query_id", "case_id"), rel, q.select(F.col("query_id").alias("case_id")), (k,))
        row = m.agg(F.lit(k).cast("bigint").alias("k"), F.avg(f"recall_{k}").alias("recall"), F.count(F.lit(1)).alias("queries"))
        out = row if out is None else out.unionByName(row)
    return out


@query("text_vectors", "I13 C9")
def _(t):
    texts = t.scan("documents").select("text").unionByName(t.user_turns.select("text"))
    encoder = fit_hashing_encoder(texts, EMBEDDING_DIM)
    return encoder(texts).select(F.xxhash64("text").alias("text_hash"), F.size("embedding").alias("dim"), r(vectors.norm(F.col("embedding"))).alias("norm"))


@query("loo_features_with_text", "C9 I4 I5 I13")
def _(t):
    cat, l = features.build_catalog(t), examples.leave_one_out(t)
    texts = l.open_searches.select("text").unionByName(l.summaries.select("text"))
    f = examples.loo_features(t, l, cat, text_vectors=fit_hashing_encoder(texts, EMBEDDING_DIM)(texts))
    return f.select("example_id", "user_id", F.col("vector").isNotNull().alias("has_vector"), "typical_price", "total_engagement_events")


@query("stored_feature_contract", "B25", "SELECT position, name, position AS expected FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}')" for i, n in enumerate(ranking.FEATURES, 1)) + ") v(position, name) WHERE (SELECT count(*) FROM x_pf) > 0")
def _(t):
    """Names of the feature columns as they come out of stored ranking rows, beside the places the model expects them in."""
    cat, l, f = loo_ranking(t)
    hits = ranker._search(f.where("example_id < 0"), t.embeddings, 5, P)
    cand = hits.select(F.col("query_id").alias("example_id"), F.col("item_id").alias("product_id"), F.col("score").alias("retrieval_score"), (F.col("rank") - 1).alias("retrieval_rank"))
    rows = stage(ranking.feature_rows(cand, f, cat.features, t.embeddings, 5), "contract_rows")
    saved = [c for c in rows.columns if c not in ("example_id", "product_id")]
    ranking.check_feature_columns(saved)
    names = [(i, n, list(ranking.FEATURES).index(n) + 1) for i, n in enumerate(saved, 1)]
    return t.spark.createDataFrame(names, "position bigint, name string, expected bigint").where(F.lit(not rows.isEmpty()))
