"""Temporal protocol, retrieval, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import affinity, catalog, eligibility, history, metrics, retrieval, temporal
from shelfwise.params import DEFAULTS, Recency
from shelfwise.plans import evaluate, features
from shelfwise.registry.core import query, r, ts_text
from shelfwise.registry.ctes import CTES

P = DEFAULTS
KS = (5, 10, 20)
FMT = "'%Y-%m-%d %H:%M:%S.%f'"

# Top-20 eligible items per case by cosine, with and without decay.
for _arm, _vec in (("on", "x_casevecs"), ("off", "x_flatvecs")):
    CTES[f"x_top{_arm}"] = f"""
  SELECT * FROM (SELECT v.example_id AS case_id, e.product_id AS item_id, list_cosine_similarity(v.vec, e.vec) AS score,
    row_number() OVER (PARTITION BY v.example_id ORDER BY list_cosine_similarity(v.vec, e.vec) DESC, e.product_id) AS rank
    FROM {_vec} v CROSS JOIN x_vecs e JOIN x_pf p USING (product_id) WHERE p.eligible) WHERE rank <= 20"""


def metric_sql(ranked: str, by: str = "split", cases: str = "(SELECT example_id AS case_id, split FROM x_case)", relevant: str = "x_rel", ks=KS) -> str:
    per_k = []
    for k in ks:
        per_k.append(f"""SELECT c.case_id, c.{by}, {k} AS k,
          count(DISTINCT h.item_id) FILTER (h.rank <= {k}) / {k}::DOUBLE AS precision,
          coalesce(count(DISTINCT h.item_id) FILTER (h.rank <= {k}) / any_value(n.n)::DOUBLE, 0) AS recall,
          (count(h.item_id) FILTER (h.rank <= {k}) > 0)::INT::DOUBLE AS hit,
          coalesce(sum(1 / log2(h.rank + 1)) FILTER (h.rank <= {k}), 0) / coalesce((SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(any_value(n.n), {k})::BIGINT) g(i)), 1) AS ndcg
        FROM {cases} c LEFT JOIN (SELECT case_id, count(*) AS n FROM {relevant} GROUP BY 1) n USING (case_id)
        LEFT JOIN (SELECT r.* FROM {ranked} r JOIN {relevant} l ON r.case_id = l.case_id AND r.item_id = l.item_id) h ON h.case_id = c.case_id GROUP BY 1, 2""")
    union = " UNION ALL ".join(per_k)
    return f"""
  SELECT {by}, count(*) AS cases, metric, k, round(avg(value), 6) AS value FROM (
    UNPIVOT (SELECT {by}, k::BIGINT AS k, precision, recall, hit, ndcg FROM ({union})) ON precision, recall, hit, ndcg INTO NAME metric VALUE value)
  GROUP BY {by}, metric, k
  UNION ALL
  SELECT {by}, count(*) AS cases, 'mrr', 0::BIGINT, round(avg(rr), 6) FROM (
    SELECT c.case_id, c.{by}, coalesce(1 / min(h.rank)::DOUBLE, 0) AS rr FROM {cases} c
    LEFT JOIN (SELECT r.* FROM {ranked} r JOIN {relevant} l ON r.case_id = l.case_id AND r.item_id = l.item_id) h ON h.case_id = c.case_id GROUP BY 1, 2) GROUP BY {by}"""


def long_metrics(df):
    return df.withColumn("value", r("value"))


EARLY = "TIMESTAMP '2024-01-06 00:00:00'"


@query("temporal_splits", "D17 E2", f"""
  SELECT s.user_id, tier, strftime(val_cutoff, {FMT}) AS val_cutoff, strftime(test_cutoff, {FMT}) AS test_cutoff,
         count(p.event_id) FILTER (val_cutoff IS NULL OR p.action_time < val_cutoff) AS train_purchases, total_purchases
  FROM x_split s LEFT JOIN x_purch p USING (user_id) GROUP BY ALL""")
def _(t):
    s = temporal.splits(t.events, t.users)
    return s.withColumn("val_cutoff", ts_text("val_cutoff")).withColumn("test_cutoff", ts_text("test_cutoff"))


@query("temporal_splits_first_days", "D17 E2", f"""
  WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY action_time DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n
             FROM x_purch WHERE action_time < {EARLY}),
  s AS (SELECT user_id, max(n) AS n, max(action_time) FILTER (rn = 1) AS t1, max(action_time) FILTER (rn = 2) AS t2 FROM p GROUP BY 1)
  SELECT u.user_id, CASE WHEN n >= 3 THEN 'FULL' WHEN n = 2 THEN 'VAL_ONLY' WHEN n = 1 THEN 'INSUFFICIENT_DEPTH' WHEN e.user_id IS NOT NULL THEN 'ENGAGEMENT_NO_PURCHASE' ELSE 'NO_HISTORY' END AS tier,
         strftime(CASE WHEN n >= 3 THEN t2 WHEN n = 2 THEN t1 END, {FMT}) AS val_cutoff, strftime(CASE WHEN n >= 3 THEN t1 END, {FMT}) AS test_cutoff, coalesce(n, 0) AS total_purchases
  FROM x_users u LEFT JOIN s USING (user_id) LEFT JOIN (SELECT DISTINCT user_id FROM x_log WHERE action_time < {EARLY}) e USING (user_id)""")
def _(t):
    early = history.before(t.events, F.lit("2024-01-06 00:00:00").cast("timestamp_ntz"))
    s = temporal.splits(early, t.users)
    return s.drop("train_purchases").withColumn("val_cutoff", ts_text("val_cutoff")).withColumn("test_cutoff", ts_text("test_cutoff"))


@query("temporal_targets", "D17 G5", "SELECT user_id, split, product_id FROM x_target")
def _(t):
    return temporal.targets(t.events, temporal.splits(t.events, t.users))


@query("purchases_in_window", "B13", """
  SELECT DISTINCT s.user_id, p.product_id FROM x_split s JOIN x_purch p USING (user_id)
  WHERE p.action_time >= s.val_cutoff AND (s.test_cutoff IS NULL OR p.action_time < s.test_cutoff)""")
def _(t):
    s = temporal.splits(t.events, t.users).where("val_cutoff IS NOT NULL")
    return temporal.window_targets(t.events, s.select("user_id", F.col("val_cutoff").alias("lower"), F.col("test_cutoff").alias("upper")))


@query("point_in_time_history", "B12 C10", """
  SELECT c.user_id, c.split, l.event_id, l.product_id, l.signal FROM x_case c JOIN x_log l ON l.user_id = c.user_id AND l.action_time < c.cutoff""")
def _(t):
    s = temporal.splits(t.events, t.users)
    cases = temporal.cases(s, temporal.targets(t.events, s)).select("user_id", "split", "cutoff")
    rows = temporal.point_in_time(t.events.select("event_id", "user_id", "product_id", "action_type", "action_time"), cases)
    return rows.select("user_id", "split", "event_id", "product_id", history.signal_of(F.col("action_type")).alias("signal"))


@query("case_event_counts", "C10 D14", """
  SELECT example_id, click_count, purchase_count, distinct_products_purchased, cart_item_count, search_count, has_chatbot_context, total_engagement_events FROM x_casecounts""")
def _(t):
    s = temporal.splits(t.events, t.users)
    cases = temporal.cases(s, temporal.targets(t.events, s))
    hist = history.case_history(history.signals(t.events), cases, P.features.recency)
    return history.engagement_counts(hist, cases).drop("user_id")


@query("leakage_audit", "B19", """
  SELECT user_id, split, 0::BIGINT AS violations, 0::BIGINT AS without_time, 0::BIGINT AS on_targets FROM x_case""")
def _(t):
    s = temporal.splits(t.events, t.users)
    target = temporal.targets(t.events, s)
    cases = temporal.cases(s, target).select("user_id", "split", "cutoff")
    return temporal.audit(temporal.point_in_time(t.events, cases).drop("cutoff"), cases, target).drop("cutoff")


@query("leakage_audit_untruncated", "B19", """
  SELECT c.user_id, c.split, count(*) FILTER (l.action_time >= c.cutoff) AS violations, 0::BIGINT AS without_time,
         count(*) FILTER (l.action_time >= c.cutoff AND t.product_id IS NOT NULL) AS on_targets
  FROM x_case c JOIN x_log l USING (user_id) LEFT JOIN x_target t ON t.user_id = c.user_id AND t.split = c.split AND t.product_id = l.product_id GROUP BY 1, 2""")
def _(t):
    s = temporal.splits(t.events, t.users)
    target = temporal.targets(t.events, s)
    cases = temporal.cases(s, target).select("user_id", "split", "cutoff")
    unsafe = t.events.join(cases.select("user_id", "split"), "user_id")
    return temporal.audit(unsafe, cases, target).drop("cutoff")


@query("lifetime_purchases", "D18", "SELECT DISTINCT user_id, product_id FROM x_log WHERE action_type = 'PURCHASE'")
def _(t):
    return temporal.purchased_pairs(t.events)


@query("repeat_targets", "G3 D37", """
  SELECT DISTINCT t.user_id, t.split, t.product_id FROM x_target t JOIN x_case c USING (user_id, split)
  JOIN x_purch p ON p.user_id = t.user_id AND p.product_id = t.product_id AND p.action_time < c.cutoff""")
def _(t):
    s = temporal.splits(t.events, t.users)
    return temporal.repeat_targets(t.events, s, temporal.targets(t.events, s))


@query("split_statistics", "D37", """
  SELECT 'users_' || lower(tier) AS statistic, count(*) AS value FROM x_split GROUP BY 1
  UNION ALL SELECT split || '_targets', count(*) FROM x_target GROUP BY split
  UNION ALL SELECT split || '_distinct_target_products', count(DISTINCT product_id) FROM x_target GROUP BY split
  UNION ALL SELECT split || '_evaluable_users', count(DISTINCT user_id) FROM x_target GROUP BY split
  UNION ALL SELECT split || '_users_with_repeat_targets', count(DISTINCT user_id) FROM (
    SELECT t.user_id, t.split FROM x_target t JOIN x_case c USING (user_id, split)
    JOIN x_purch p ON p.user_id = t.user_id AND p.product_id = t.product_id AND p.action_time < c.cutoff) GROUP BY split
  UNION ALL SELECT 'train_purchases', count(*) FROM x_purch p JOIN x_split s USING (user_id) WHERE s.val_cutoff IS NULL OR p.action_time < s.val_cutoff
  UNION ALL SELECT 'events', count(*) FROM x_log
  UNION ALL SELECT 'purchase_events', count(*) FROM x_purch""")
def _(t):
    s = temporal.splits(t.events, t.users)
    target = temporal.targets(t.events, s)
    return temporal.split_statistics(t.events, s, target, temporal.repeat_targets(t.events, s, target))


@query("split_date_ranges", "D37", f"""
  SELECT 'events' AS what, strftime(min(action_time), {FMT}) AS first, strftime(max(action_time), {FMT}) AS last FROM x_log
  UNION ALL SELECT 'purchases', strftime(min(action_time), {FMT}), strftime(max(action_time), {FMT}) FROM x_purch
  UNION ALL SELECT split || '_cutoffs', strftime(min(cutoff), {FMT}), strftime(max(cutoff), {FMT}) FROM x_case GROUP BY split""")
def _(t):
    s = temporal.splits(t.events, t.users)
    cases = temporal.cases(s, temporal.targets(t.events, s))
    rng = lambda df, col: (ts_text(F.min(col)).alias("first"), ts_text(F.max(col)).alias("last"))
    log = t.events.agg(*rng(t.events, "action_time")).select(F.lit("events").alias("what"), "first", "last")
    buy = temporal.timed_purchases(t.events).agg(*rng(t.events, "action_time")).select(F.lit("purchases").alias("what"), "first", "last")
    cut = cases.groupBy("split").agg(*rng(cases, "cutoff")).select(F.concat("split", F.lit("_cutoffs")).alias("what"), "first", "last")
    return log.unionByName(buy).unionByName(cut)


@query("user_timeline", "J14", """
  SELECT l.event_id, l.user_id, CASE WHEN coalesce(test_cutoff, val_cutoff) IS NULL OR action_time < coalesce(test_cutoff, val_cutoff) THEN 'past'
         WHEN action_type = 'PURCHASE' THEN 'target' ELSE 'held_out' END AS role
  FROM x_log l LEFT JOIN x_split s USING (user_id)""")
def _(t):
    return temporal.timeline(t.events, temporal.splits(t.events, t.users)).select("event_id", "user_id", "role")


@query("chronological_position", "E1", """
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY action_time ASC NULLS LAST, event_id) AS position FROM x_log""")
def _(t):
    return temporal.chronological(t.events).select("event_id", "user_id", "position")


@query("distinct_target_products", "G2", "SELECT split, product_id FROM x_target UNION SELECT 'all', product_id FROM x_target")
def _(t):
    target = temporal.targets(t.events, temporal.splits(t.events, t.users)).select("split", "product_id").distinct()
    return target.unionByName(target.select(F.lit("all").alias("split"), "product_id").distinct())


@query("targets_by_eligibility", "B9", """
  SELECT split, eligible, count(*) AS products FROM (SELECT DISTINCT split, product_id FROM x_target) LEFT JOIN x_pf USING (product_id) GROUP BY 1, 2""")
def _(t):
    target = temporal.targets(t.events, temporal.splits(t.events, t.users)).select("split", "product_id").distinct()
    checked = eligibility.apply_rules(target, "product_id", catalog.denormalise(t), P.eligibility)
    return checked.groupBy("split", "eligible").agg(F.count(F.lit(1)).alias("products"))


@query("held_out_products", "G5", "SELECT user_id, string_agg(DISTINCT product_id::VARCHAR, ',' ORDER BY product_id::VARCHAR) AS held_out FROM x_target GROUP BY 1")
def _(t):
    target = temporal.targets(t.events, temporal.splits(t.events, t.users))
    return target.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("product_id").cast("string"))), ",").alias("held_out"))


# --- retrieval and metrics ----------------------------------------------------------------------

@query("case_top20_cosine", "C11 C12 F1 F3 E7", """
  SELECT case_id, item_id, rank, round(score, 6) AS score FROM x_topon""")
def _(t):
    tc = evaluate.temporal_cases(t)
    top = evaluate.vector_rankings(t, evaluate.case_history(t, tc.cases, P.features.recency), evaluate.eligible_ids(t), 20)
    return top.withColumn("score", r("score"))


@query("bounded_neighbours", "F1 F3 C11 C12", """
  SELECT query_id, item_id, rank, round(score, 6) AS score FROM (
    SELECT a.product_id AS query_id, b.product_id AS item_id, list_cosine_similarity(a.vec, b.vec) AS score,
           row_number() OVER (PARTITION BY a.product_id ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.product_id) AS rank
    FROM x_vecs a CROSS JOIN (SELECT v.product_id, v.vec FROM x_vecs v JOIN x_pf USING (product_id) WHERE eligible) b) WHERE rank <= 10""")
def _(t):
    e = t.embeddings
    hits, _ = retrieval.bounded_topk(e.select(F.col("product_id").alias("query_id"), F.col("embedding").alias("vector")),
                                     e.select(F.col("product_id").alias("item_id"), F.col("embedding").alias("vector")), 10, P.retrieval, allowed=evaluate.eligible_ids(t))
    return hits.withColumn("score", r("score"))


@query("item_neighbours", "F1 C11", """
  SELECT query_id, item_id, rank, round(score, 6) AS score FROM (
    SELECT a.product_id AS query_id, b.product_id AS item_id, list_cosine_similarity(a.vec, b.vec) AS score,
           row_number() OVER (PARTITION BY a.product_id ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.product_id) AS rank
    FROM x_vecs a CROSS JOIN x_vecs b) WHERE rank <= 10""")
def _(t):
    e = t.embeddings
    hits = retrieval.exact_topk(e.select(F.col("product_id").alias("query_id"), F.col("embedding").alias("vector")),
                                e.select(F.col("product_id").alias("item_id"), F.col("embedding").alias("vector")), 10, P.retrieval)
    return hits.withColumn("score", r("score"))


@query("ranked_rows_from_arrays", "H17", """
  SELECT query_id, item_id, rank, round(score, 6) AS score FROM (
    SELECT a.product_id AS query_id, b.product_id AS item_id, list_cosine_similarity(a.vec, b.vec) AS score,
           row_number() OVER (PARTITION BY a.product_id ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.product_id) AS rank
    FROM x_vecs a CROSS JOIN x_vecs b) WHERE rank <= 5""")
def _(t):
    e = t.embeddings
    hits = retrieval.exact_topk(e.select(F.col("product_id").alias("query_id"), F.col("embedding").alias("vector")),
                                e.select(F.col("product_id").alias("item_id"), F.col("embedding").alias("vector")), 5, P.retrieval)
    packed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("s"))
    arrays = packed.select("query_id", F.col("s.item_id").alias("item_ids"), F.col("s.score").alias("scores"))
    return retrieval.ranked_rows(arrays).withColumn("score", r("score"))


@query("hit_marking", "C17", """
  SELECT t.case_id, t.rank, t.item_id, r.item_id IS NOT NULL AS hit FROM x_topon t LEFT JOIN x_rel r ON r.case_id = t.case_id AND r.item_id = t.item_id""")
def _(t):
    tc = evaluate.temporal_cases(t)
    top = evaluate.vector_rankings(t, evaluate.case_history(t, tc.cases, P.features.recency), evaluate.eligible_ids(t), 20)
    return top.join(tc.relevant.withColumn("hit", F.lit(True)), ["case_id", "item_id"], "left").select(
        "case_id", "rank", "item_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("case_metrics", "D20 D21 D22 D23", """
  SELECT c.example_id AS case_id, round(coalesce(1 / min(h.rank)::DOUBLE, 0), 6) AS rr,
         round(count(h.item_id) FILTER (h.rank <= 10) / 10.0::DOUBLE, 6) AS precision_10,
         round(count(h.item_id) FILTER (h.rank <= 10) / any_value(n.n)::DOUBLE, 6) AS recall_10,
         round(coalesce(sum(1 / log2(h.rank + 1)) FILTER (h.rank <= 10), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(any_value(n.n), 10)::BIGINT) g(i)), 6) AS ndcg_10
  FROM x_case c JOIN (SELECT case_id, count(*) AS n FROM x_rel GROUP BY 1) n ON n.case_id = c.example_id
  LEFT JOIN (SELECT t.* FROM x_topon t JOIN x_rel r ON r.case_id = t.case_id AND r.item_id = t.item_id) h ON h.case_id = c.example_id GROUP BY 1""")
def _(t):
    tc = evaluate.temporal_cases(t)
    top = evaluate.vector_rankings(t, evaluate.case_history(t, tc.cases, P.features.recency), evaluate.eligible_ids(t), 20)
    m = metrics.case_metrics(top, tc.relevant, tc.ids, (10,))
    return m.select("case_id", *[r(c).alias(c) for c in ("rr", "precision_10", "recall_10", "ndcg_10")])


@query("temporal_retrieval_metrics", "J5 D20", metric_sql("x_topon"))
def _(t):
    tc = evaluate.temporal_cases(t)
    top = evaluate.vector_rankings(t, evaluate.case_history(t, tc.cases, P.features.recency), evaluate.eligible_ids(t), 20)
    return long_metrics(evaluate.evaluate_lists(top, tc.relevant, tc.ids, KS, ["split"]))


@query("recency_experiment", "J9", f"""
  SELECT 'decay_on' AS arm, * FROM ({metric_sql("x_topon")}) UNION ALL SELECT 'decay_off' AS arm, * FROM ({metric_sql("x_topoff")})""")
def _(t):
    x = evaluate.recency_experiment(t)
    parts = [evaluate.evaluate_lists(x[a], x["relevant"], x["cases"], KS, ["split"]).withColumn("arm", F.lit(a)) for a in ("decay_on", "decay_off")]
    return long_metrics(parts[0].unionByName(parts[1]))


@query("recency_experiment_lists", "J9 D24 D25 D26 D27", """
  SELECT arm, round(avg(cats), 6) AS mean_distinct_categories, round(avg((dup)::INT), 6) AS duplicate_rate, round(avg(n / 20.0::DOUBLE), 6) AS fill_rate,
         round(any_value(cov) / (SELECT count(*) FROM x_pf WHERE eligible)::DOUBLE, 6) AS coverage
  FROM (SELECT arm, case_id, count(DISTINCT category_name) AS cats, count(*) > count(DISTINCT item_id) AS dup, count(*) AS n
        FROM (SELECT 'decay_on' AS arm, * FROM x_topon UNION ALL SELECT 'decay_off', * FROM x_topoff) JOIN x_catalog ON product_id = item_id GROUP BY 1, 2)
  JOIN (SELECT 'decay_on' AS arm, count(DISTINCT item_id) AS cov FROM x_topon UNION ALL SELECT 'decay_off', count(DISTINCT item_id) FROM x_topoff) USING (arm) GROUP BY arm""")
def _(t):
    x = evaluate.recency_experiment(t)
    cat = catalog.denormalise(t)
    size = evaluate.eligible_ids(t).agg(F.count(F.lit(1)).alias("n")).scalar()
    out = None
    for arm in ("decay_on", "decay_off"):
        q = metrics.list_quality(x[arm], x["cases"], cat, 20)
        row = metrics.mean_quality(q, x[arm], size, 20).select(F.lit(arm).alias("arm"), *[r(c).alias(c) for c in ("mean_distinct_categories", "duplicate_rate", "fill_rate", "coverage")])
        out = row if out is None else out.unionByName(row)
    return out


@query("paired_decay_hits", "D31", """
  SELECT hit_a, hit_b, count(*) AS cases FROM (
    SELECT c.example_id, coalesce(bool_or(a.case_id IS NOT NULL), false) AS hit_a, coalesce(bool_or(b.case_id IS NOT NULL), false) AS hit_b FROM x_case c
    LEFT JOIN (SELECT t.case_id FROM x_topoff t JOIN x_rel r ON r.case_id = t.case_id AND r.item_id = t.item_id AND t.rank <= 10) a ON a.case_id = c.example_id
    LEFT JOIN (SELECT t.case_id FROM x_topon t JOIN x_rel r ON r.case_id = t.case_id AND r.item_id = t.item_id AND t.rank <= 10) b ON b.case_id = c.example_id GROUP BY 1) GROUP BY 1, 2""")
def _(t):
    x = evaluate.recency_experiment(t)
    a, b = (metrics.case_metrics(x[arm], x["relevant"], x["cases"], (10,)) for arm in ("decay_off", "decay_on"))
    return metrics.paired_hits(a, b, 10)


@query("metrics_by_split_rollup", "D29", """
  SELECT coalesce(split, 'all') AS split, count(*) AS cases, round(avg(hit), 6) AS hit_rate_10 FROM (
    SELECT c.split, c.example_id, (count(h.item_id) > 0)::INT::DOUBLE AS hit FROM x_case c
    LEFT JOIN (SELECT t.* FROM x_topon t JOIN x_rel r ON r.case_id = t.case_id AND r.item_id = t.item_id WHERE t.rank <= 10) h ON h.case_id = c.example_id GROUP BY 1, 2)
  GROUP BY ROLLUP(split)""")
def _(t):
    tc = evaluate.temporal_cases(t)
    top = evaluate.vector_rankings(t, evaluate.case_history(t, tc.cases, P.features.recency), evaluate.eligible_ids(t), 20)
    m = metrics.case_metrics(top, tc.relevant, tc.ids, (10,))
    return m.rollup("split").agg(F.count(F.lit(1)).alias("cases"), r(F.avg("hit_10")).alias("hit_rate_10")).withColumn("split", F.coalesce("split", F.lit("all")))


@query("price_fallback_distribution", "D30", "SELECT fallback_source, count(*) AS cases FROM x_caseprice GROUP BY 1 UNION ALL SELECT 'live_' || fallback_source, count(*) FROM x_liveprice GROUP BY 1")
def _(t):
    tc = evaluate.temporal_cases(t)
    cat = catalog.denormalise(t)
    users, ctx, cp = catalog.users(t), catalog.price_context(cat), catalog.category_prices(cat)

    def dist(hist, ex):
        prof = affinity.price_profiles(affinity.price_summary(affinity.purchase_prices(hist, cat)), ex, users, cat, ctx, cp)
        return prof.groupBy("fallback_source").agg(F.count(F.lit(1)).alias("cases"))

    live = history.live_history(history.signals(t.events), Recency(enabled=False))
    a = dist(evaluate.case_history(t, tc.cases, P.features.recency), tc.cases)
    b = dist(live, features.live_examples(users)).withColumn("fallback_source", F.concat(F.lit("live_"), "fallback_source"))
    return a.unionByName(b)
