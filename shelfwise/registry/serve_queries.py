"""Candidates, re-ranking and recommendations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from shelfwise.operators import candidates as cand
from shelfwise.operators import catalog, history, metrics, rerank, retrieval, temporal
from shelfwise.params import DEFAULTS
from shelfwise.plans import evaluate, features, serve
from shelfwise.registry.core import long, query, r
from shelfwise.registry.ctes import CTES, affinity, counts, history as history_sql, user_vector
from shelfwise.registry.temporal_queries import KS, long_metrics, metric_sql

P = DEFAULTS
POOL = 50
#: Signals of a long history in the queries that look at all tiers.
MIXED = 70
MIXED_PARAMS = replace(P, cold_start=replace(P.cold_start, strong_history_min_signals=MIXED))

# --- check SQL of the serving plan -----------------------------------------------------------------
CTES["x_elig"] = """
  SELECT *, row_number() OVER (ORDER BY purchase_count DESC, cart_add_count DESC, product_id) AS grank, count(*) OVER () AS gn,
         row_number() OVER (PARTITION BY category_name ORDER BY purchase_count DESC, cart_add_count DESC, product_id) AS crank,
         count(*) OVER (PARTITION BY category_name) AS cn
  FROM x_pf WHERE eligible"""


def lists_sql(feats: str, vecs: str, elig: str) -> str:
    """Candidate pools (example_id, pos, product_id, score, source) of all three tiers."""
    score = "CASE WHEN n <= 1 THEN 1 ELSE 1 - (rank - 1) / (n - 1)::DOUBLE END"
    return f"""
  SELECT example_id, pos, product_id, score, source FROM (
    SELECT example_id, product_id, score, 'personalized' AS source, rank AS pos FROM x_own_{feats} WHERE tier = 'strong'
    UNION ALL
    SELECT example_id, product_id, score, source, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, seen) AS pos FROM (
      SELECT example_id, product_id, max(w * {score}) AS score, arg_max(source, (w * {score}) * 1e6 - so) AS source, min(so * 1000000 + rank) AS seen FROM (
        SELECT example_id, product_id, 0 AS so, 'personalized' AS source, 0.6::DOUBLE AS w, rank, count(*) OVER (PARTITION BY example_id) AS n FROM x_own_{feats} WHERE tier = 'sparse'
        UNION ALL SELECT f.example_id, e.product_id, 1, 'preferred_category', 0.2::DOUBLE, e.crank, e.cn FROM {feats} f JOIN {elig} e ON e.category_name = f.preferred_category WHERE f.tier = 'sparse'
        UNION ALL SELECT f.example_id, e.product_id, 2, 'popularity', 0.2::DOUBLE, e.grank, e.gn FROM {feats} f CROSS JOIN {elig} e WHERE f.tier = 'sparse')
      GROUP BY 1, 2)
    UNION ALL
    SELECT example_id, product_id, score, source, row_number() OVER (PARTITION BY example_id ORDER BY seen) AS pos FROM (
      SELECT example_id, product_id, arg_min({score}, so * 1000000 + rank) AS score, arg_min(source, so * 1000000 + rank) AS source, min(so * 1000000 + rank) AS seen FROM (
        SELECT f.example_id, e.product_id, 0 AS so, 'preferred_category' AS source, e.crank AS rank, e.cn AS n FROM {feats} f JOIN {elig} e ON e.category_name = f.preferred_category WHERE f.tier = 'no_history' AND e.crank <= {POOL}
        UNION ALL SELECT f.example_id, e.product_id, 1, 'category_popularity', e.crank, e.cn FROM {feats} f JOIN {elig} e ON e.category_name = f.top_category WHERE f.tier = 'no_history' AND e.crank <= {POOL}
        UNION ALL SELECT f.example_id, e.product_id, 2, 'global_popularity', e.grank, e.gn FROM {feats} f CROSS JOIN {elig} e WHERE f.tier = 'no_history' AND e.grank <= {POOL})
      GROUP BY 1, 2)) WHERE pos <= {POOL}"""


def own_sql(feats: str, vecs: str, elig: str) -> str:
    return f"""
  SELECT * FROM (SELECT f.example_id, f.tier, x.product_id, list_cosine_similarity(v.vec, x.vec) AS score,
    row_number() OVER (PARTITION BY f.example_id ORDER BY list_cosine_similarity(v.vec, x.vec) DESC, x.product_id) AS rank
    FROM {feats} f JOIN {vecs} v USING (example_id) CROSS JOIN x_vecs x JOIN {elig} e ON e.product_id = x.product_id WHERE f.tier <> 'no_history') WHERE rank <= {POOL}"""


def greedy_sql(lists: str, steps: int) -> str:
    return f"""
  SELECT example_id, 0 AS step, []::BIGINT[] AS sel, ids, sc, cats, brs, src FROM (
    SELECT l.example_id, list(l.product_id ORDER BY pos) AS ids, list(score ORDER BY pos) AS sc, list(category_name ORDER BY pos) AS cats,
           list(brand ORDER BY pos) AS brs, list(source ORDER BY pos) AS src
    FROM {lists} l JOIN x_catalog USING (product_id) GROUP BY 1)
  UNION ALL
  SELECT example_id, step + 1, list_append(sel, list_position(adj, list_max(adj))::BIGINT), ids, sc, cats, brs, src FROM (
    SELECT *, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_contains(sel, i) THEN -1e300::DOUBLE ELSE
        sc[i] - 0.5::DOUBLE * (len(list_filter(sel, lambda s: cats[s] = cats[i])) * 0.15::DOUBLE + len(list_filter(sel, lambda s: brs[s] = brs[i])) * 0.08::DOUBLE) END) AS adj
    FROM x_greedy_{lists} WHERE step < least(len(ids), {steps}))"""


def final_sql(lists: str, steps: int) -> str:
    return f"""
  SELECT example_id, rank, ids[i] AS product_id, sc[i] AS score, src[i] AS source FROM (
    SELECT example_id, ids, sc, src, unnest(sel) AS i, generate_subscripts(sel, 1) AS rank FROM x_greedy_{lists} g
    WHERE step = least(len(ids), {steps}))"""


def tiered(counts_cte: str, cats: str, name: str, strong: int = 5):
    CTES[name] = f"""
  SELECT c.example_id, c.user_id, u.preferred_category, t.name AS top_category,
         CASE WHEN total_engagement_events >= {strong} THEN 'strong' WHEN total_engagement_events >= 1 THEN 'sparse' ELSE 'no_history' END AS tier
  FROM {counts_cte} c LEFT JOIN x_users u USING (user_id) LEFT JOIN (SELECT * FROM {cats} WHERE rank = 1) t ON t.example_id = c.example_id"""


# the log cut shortly after its start: most users have few events, so all tiers occur
CTES["x_early0"] = """
  SELECT user_id AS example_id, user_id, TIMESTAMP '2024-01-02 06:00:00' AS cutoff, signal, product_id, action_time FROM x_log
  WHERE action_time < TIMESTAMP '2024-01-02 06:00:00'"""
CTES["x_earlyhist"] = history_sql("x_early0")
CTES["x_earlycat"] = affinity("x_earlyhist", "x_live", "category_name")
CTES["x_earlyvec"] = user_vector("x_earlyhist")
CTES["x_earlyvecs"] = "SELECT example_id, list(v ORDER BY pos) AS vec FROM x_earlyvec GROUP BY 1"
CTES["x_earlycounts"] = counts("x_earlyhist", "x_live")
CTES["x_earlyelig"] = """
  SELECT product_id, category_name, brand, row_number() OVER (ORDER BY pc DESC, kc DESC, product_id) AS grank, count(*) OVER () AS gn,
         row_number() OVER (PARTITION BY category_name ORDER BY pc DESC, kc DESC, product_id) AS crank, count(*) OVER (PARTITION BY category_name) AS cn
  FROM (SELECT p.product_id, p.category_name, p.brand, count(*) FILTER (signal = 'purchase') AS pc, count(*) FILTER (signal = 'cart') AS kc
        FROM x_catalog p LEFT JOIN x_early0 l USING (product_id) WHERE p.is_active AND p.stock_quantity > 0 GROUP BY 1, 2, 3)"""
CTES["x_caseelig"] = """
  SELECT product_id, category_name, brand, row_number() OVER (ORDER BY product_id) AS grank, count(*) OVER () AS gn,
         row_number() OVER (PARTITION BY category_name ORDER BY product_id) AS crank, count(*) OVER (PARTITION BY category_name) AS cn
  FROM x_catalog WHERE is_active AND stock_quantity > 0"""

tiered("x_livecounts", "x_livecat", "x_livetier")
tiered("x_earlycounts", "x_earlycat", "x_earlytier")
tiered("x_casecounts", "x_casecat", "x_casetier")
# with a higher limit for a long history many users of the whole log have a short one
tiered("x_livecounts", "x_livecat", "x_mixed", MIXED)
# no product of the log has a vector: a long history then gets the lists of users without history
CTES["x_bare"] = "SELECT * REPLACE (CASE WHEN tier = 'strong' THEN 'no_history' ELSE tier END AS tier) FROM x_livetier"
CTES["x_novecs"] = "SELECT example_id, vec FROM x_livevecs WHERE false"
for _feats, _vecs, _elig, _steps in (("x_livetier", "x_livevecs", "x_elig", 10), ("x_earlytier", "x_earlyvecs", "x_earlyelig", 10), ("x_casetier", "x_casevecs", "x_caseelig", 10),
                                      ("x_bare", "x_novecs", "x_elig", 10), ("x_mixed", "x_livevecs", "x_elig", 10)):
    CTES[f"x_own_{_feats}"] = own_sql(_feats, _vecs, _elig)
    CTES[f"x_pool_{_feats}"] = lists_sql(_feats, _vecs, _elig)
    CTES[f"x_greedy_x_pool_{_feats}"] = greedy_sql(f"x_pool_{_feats}", _steps)
    CTES[f"x_final_{_feats}"] = final_sql(f"x_pool_{_feats}", _steps)
# complete greedy orders of the popularity lists per category
CTES["x_catlists"] = f"SELECT category_id AS example_id, crank AS pos, product_id, CASE WHEN cn <= 1 THEN 1 ELSE 1 - (crank - 1) / (cn - 1)::DOUBLE END AS score, 'category' AS source FROM x_elig WHERE crank <= {POOL}"
CTES["x_greedy_x_catlists"] = greedy_sql("x_catlists", POOL)
CTES["x_final_catlists"] = final_sql("x_catlists", POOL)


def early(t):
    return history.before(t.events, F.lit("2024-01-02 06:00:00").cast("timestamp_ntz"))


def live_recommendations(t, top_n=None, scorer=None):
    cat = features.build_catalog(t)
    feats = evaluate.stage(features.live_user_features(t, cat), "user_features")
    return cat, feats, serve.recommend(feats, cat, t.embeddings, P, top_n, scorer)


def early_recommendations(t):
    cat = features.build_catalog(t, events=early(t))
    feats = evaluate.stage(features.live_user_features(t, cat, as_of=F.lit("2024-01-02 06:00:00").cast("timestamp_ntz"), events=early(t)), "user_features")
    return cat, feats, serve.recommend(feats, cat, t.embeddings, P)


def flat(items):
    return items.select(F.col("example_id").alias("user_id"), "rank", "product_id", r("score").alias("score"), "source")


@query("history_tiers", "B6 D28", "SELECT tier, count(*) AS users FROM x_mixed GROUP BY 1")
def _(t):
    hist = history.live_history(history.signals(t.events), P.features.recency, features.latest_time(t.events))
    n = history.engagement_counts(hist, features.live_examples(catalog.users(t)))
    return n.groupBy(cand.history_tier(F.col("total_engagement_events"), MIXED_PARAMS.cold_start).alias("tier")).agg(F.count(F.lit(1)).alias("users"))


@query("candidate_pool_size", "B21", "SELECT n, least(greatest(n * 5, 50), (SELECT count(*) FROM x_pf WHERE eligible))::BIGINT AS pool FROM (SELECT unnest([5, 10, 20, 50, 1000])::BIGINT AS n)")
def _(t):
    size = evaluate.eligible_ids(t).agg(F.count(F.lit(1)).alias("c"))
    p = P.retrieval
    rows = size.select("c", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (5, 10, 20, 50, 1000)])).alias("n"))
    return rows.select("n", F.least(F.greatest(F.col("n") * p.candidate_pool_multiplier, F.lit(p.min_candidate_pool).cast("bigint")), F.col("c")).alias("pool"))


@query("unknown_product_hits", "B22", """
  SELECT query_id, count(*) AS dropped FROM (
    SELECT a.product_id AS query_id, b.product_id AS item_id, row_number() OVER (PARTITION BY a.product_id ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.product_id) AS rank
    FROM x_vecs a CROSS JOIN x_vecs b) WHERE rank <= 10 AND item_id NOT IN (SELECT product_id FROM x_catalog WHERE is_active) GROUP BY 1""")
def _(t):
    e = t.embeddings
    hits = retrieval.exact_topk(e.select(F.col("product_id").alias("query_id"), F.col("embedding").alias("vector")),
                                e.select(F.col("product_id").alias("item_id"), F.col("embedding").alias("vector")), 10, P.retrieval)
    return retrieval.with_known_products(hits, t.products.where("is_active = 1"))[1]


@query("unknown_users", "B23", "SELECT DISTINCT user_id FROM (SELECT o_custkey * 2 AS user_id FROM orders) WHERE user_id NOT IN (SELECT user_id FROM x_users)")
def _(t):
    return serve.unknown_users(t.orders.select((F.col("user_id") * 2).alias("user_id")).distinct(), t.users)


@query("blended_candidates", "F6 G1 E6 E10", """
  SELECT example_id AS user_id, pos AS position, product_id, round(score, 6) AS score, source FROM x_pool_x_mixed
  WHERE example_id IN (SELECT example_id FROM x_mixed WHERE tier = 'sparse')""")
def _(t):
    cat = features.build_catalog(t)
    feats = evaluate.stage(features.live_user_features(t, cat), "user_features")
    pool = serve.recommend(feats, cat, t.embeddings, MIXED_PARAMS).pool
    sparse = feats.where(cand.history_tier(F.col("total_engagement_events"), MIXED_PARAMS.cold_start) == "sparse").select("example_id")
    return pool.join(sparse, "example_id", "left_semi").select(F.col("example_id").alias("user_id"), "position", "product_id", r("score").alias("score"), "source")


@query("waterfall_candidates", "F7 G1", """
  SELECT example_id AS user_id, pos AS position, product_id, round(score, 6) AS score, source FROM x_pool_x_livetier
  WHERE example_id IN (SELECT example_id FROM x_livetier WHERE tier = 'no_history')""")
def _(t):
    _, feats, rec = live_recommendations(t)
    idle = feats.where("total_engagement_events = 0").select("example_id")
    return rec.pool.join(idle, "example_id", "left_semi").select(F.col("example_id").alias("user_id"), "position", "product_id", r("score").alias("score"), "source")


@query("deduplicated_candidates", "F8", """
  SELECT user_id, product_id, min(position) AS position FROM (SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY action_time DESC, event_id) AS position FROM x_log) GROUP BY 1, 2""")
def _(t):
    pos = temporal.chronological(t.events)
    n = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rows = pos.join(n, "user_id").select("user_id", "product_id", (F.col("n") - F.col("position") + 1).alias("position"))
    return rerank.deduplicate(rows, "user_id")


@query("diversity_rerank", "F9 F10", """
  SELECT c.name AS category_name, f.rank, f.product_id, round(f.score, 6) AS score FROM x_final_catlists f JOIN x_cat c ON c.category_id = f.example_id""")
def _(t):
    f = catalog.product_features(t, t.events)
    top = cand.category_top(f.where("eligible"), POOL).join(f.select("product_id", "brand"), "product_id")
    rows = top.select("category_name", F.col("rank").alias("position"), "product_id", cand.rank_score(F.col("rank"), F.col("list_size")).alias("score"),
                      F.lit("category").alias("source"), F.col("category_name").alias("c"), "brand")
    out = rerank.rerank(rows.withColumn("list", F.col("category_name")).drop("c"), "list", P.reranking)
    return out.select(F.col("list").alias("category_name"), "rank", "product_id", r("score").alias("score"))


@query("recommendations", "J3 F11 B6 E4 E5", "SELECT example_id AS user_id, rank, product_id, round(score, 6) AS score, source FROM x_final_x_livetier")
def recommendations(t):
    return flat(live_recommendations(t)[2].items)


@query("recommendations_without_vectors", "J3 F7", "SELECT example_id AS user_id, rank, product_id, round(score, 6) AS score, source FROM x_final_x_bare")
def _(t):
    cat = features.build_catalog(t)
    unseen = t.embeddings.join(t.events.select("product_id").distinct(), "product_id", "left_anti")
    feats = evaluate.stage(features.live_user_features(t, cat, embeddings=unseen), "user_features")
    return flat(serve.recommend(feats, cat, unseen, P).items)


@query("recommendations_at_time", "J4 J3", "SELECT example_id AS user_id, rank, product_id, round(score, 6) AS score, source FROM x_final_x_earlytier")
def _(t):
    return flat(early_recommendations(t)[2].items)


@query("recommendation_counters", "J3 D27", """
  SELECT f.user_id, f.tier, 10::BIGINT AS requested_n, 50::BIGINT AS pool_size, (SELECT count(*) FROM x_pf WHERE NOT eligible) AS num_excluded_pre_retrieval,
         coalesce(n.n, 0) AS num_before_eligibility, 0::BIGINT AS num_excluded_by_eligibility, least(coalesce(n.n, 0), 10) AS returned, round(least(coalesce(n.n, 0), 10) / 10.0::DOUBLE, 6) AS fill_rate
  FROM x_livetier f LEFT JOIN (SELECT example_id, count(*) AS n FROM x_pool_x_livetier GROUP BY 1) n USING (example_id)""")
def _(t):
    m = live_recommendations(t)[2].meta
    return m.drop("example_id").withColumn("fill_rate", r("fill_rate"))


@query("recommendation_display", "A19 C19", """
  SELECT example_id AS user_id, rank, product_id, round(score, 4) AS score, source, name, category_name AS category, brand, price, is_active, stock_quantity
  FROM x_final_x_livetier JOIN x_catalog USING (product_id)""")
def _(t):
    d = serve.display_rows(live_recommendations(t)[2].items, catalog.denormalise(t))
    return d.withColumnRenamed("example_id", "user_id").withColumn("stock_quantity", long("stock_quantity"))


@query("recommendation_distribution", "J12", """
  SELECT 'source' AS what, source AS value, count(*) AS rows FROM x_final_x_livetier GROUP BY 2
  UNION ALL SELECT 'category', coalesce(category_name, '(unknown)'), count(*) FROM x_final_x_livetier JOIN x_catalog USING (product_id) GROUP BY 2""")
def _(t):
    cat, _, rec = live_recommendations(t)
    items = evaluate.stage(rec.items, "items")
    src = items.groupBy(F.col("source").alias("value")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("source").alias("what"), "value", "rows")
    named = items.join(cat.features.select("product_id", "category_name"), "product_id", "left")
    by_cat = named.groupBy(F.coalesce("category_name", F.lit("(unknown)")).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return src.unionByName(by_cat.select(F.lit("category").alias("what"), "value", "rows"))


CTES["x_servedrank"] = "SELECT example_id AS case_id, rank, product_id AS item_id FROM x_final_x_casetier"
CTES["x_poolrank"] = "SELECT example_id AS case_id, pos AS rank, product_id AS item_id FROM x_pool_x_casetier"


@query("served_metrics", "J8 D20 D21 D22 D23", metric_sql("x_servedrank"))
def _(t):
    tc, _, rec = evaluate.evaluate_recommendations(t)
    return long_metrics(evaluate.evaluate_lists(evaluate.as_ranked(rec.items), tc.relevant, tc.ids, KS, ["split"]))


@query("pool_metrics_before_rerank", "J7 J8", metric_sql("x_poolrank"))
def _(t):
    tc, _, rec = evaluate.evaluate_recommendations(t)
    return long_metrics(evaluate.evaluate_lists(evaluate.as_ranked(rec.pool.withColumnRenamed("position", "rank")), tc.relevant, tc.ids, KS, ["split"]))


@query("served_list_quality", "J8 D24 D25 D26 D27 D28", """
  SELECT round(avg(cats), 6) AS mean_distinct_categories, round(avg(dup::INT), 6) AS duplicate_rate, round(avg(n / 10.0::DOUBLE), 6) AS fill_rate,
         round((SELECT count(DISTINCT product_id) FROM x_final_x_casetier) / (SELECT count(*) FROM x_caseelig)::DOUBLE, 6) AS coverage
  FROM (SELECT example_id, count(DISTINCT category_name) AS cats, count(*) > count(DISTINCT product_id) AS dup, count(*) AS n
        FROM x_final_x_casetier JOIN x_catalog USING (product_id) GROUP BY 1)""")
def _(t):
    tc, cat, rec = evaluate.evaluate_recommendations(t)
    ranked = evaluate.stage(evaluate.as_ranked(rec.items), "served")
    size = cat.features.where("eligible").agg(F.count(F.lit(1)).alias("n")).scalar()
    q = metrics.list_quality(ranked, tc.ids, cat.features, 10)
    return metrics.mean_quality(q, ranked, size, 10).select(*[r(c).alias(c) for c in ("mean_distinct_categories", "duplicate_rate", "fill_rate", "coverage")])


@query("served_metrics_by_tier", "D29 D28", metric_sql("x_servedrank", by="tier", cases="(SELECT example_id AS case_id, tier FROM x_casetier JOIN x_case USING (example_id) WHERE split = 'test')"))
def _(t):
    tc, _, rec = evaluate.evaluate_recommendations(t)
    test = rec.meta.select(F.col("example_id").alias("case_id"), "tier").join(tc.ids.where("split = 'test'"), "case_id", "left_semi")
    return long_metrics(evaluate.evaluate_lists(evaluate.as_ranked(rec.items), tc.relevant, test, KS, ["tier"]))
