"""Retrieval, metrics, candidate merging, re-ranking, serving, ranking contract, stores and reports."""

import hashlib
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shelfwise.operators import candidates, eligibility, encode, metrics, perceptron, ranking, ranks, rerank, retrieval
from shelfwise.operators.textvec import fit_hashing_encoder
from shelfwise.params import DEFAULTS, EligibilityParams, Reranking, RetrievalParams
from shelfwise.plans import evaluate, ranker, serve
from shelfwise.plans.features import Catalog
from shelfwise.registry import ranking_queries
from shelfwise.sources import bindings, embedding_store, reports, snapshots
from shelfwise.sources.stage import stage, stage_root

RANKED = "case_id bigint, rank bigint, item_id bigint"


def per_case(spark, ranked, relevant, ks):
    df = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(ranked)], RANKED)
    rel = spark.createDataFrame([(1, x) for x in relevant], "case_id bigint, item_id bigint")
    return metrics.case_metrics(df, rel, spark.createDataFrame([(1,)], "case_id bigint"), ks).first()


def test_metrics_with_several_relevant_items(spark):
    m = per_case(spark, [10, 50, 12, 80, 20], [20, 50, 80], (5,))
    assert (m.precision_5, m.recall_5, m.hit_5, m.rr) == (0.6, 1.0, 1.0, 0.5) and m.ndcg_5 == pytest.approx(0.6797, abs=1e-4)


def test_metrics_beyond_the_list_and_with_duplicates(spark):
    m = per_case(spark, [1, 2, 3], [2], (100,))
    assert (m.precision_100, m.recall_100) == (0.01, 1.0) and m.ndcg_100 == pytest.approx(1 / math.log2(3))
    d = per_case(spark, [7, 7, 7, 8], [7], (3,))
    assert d.precision_3 == pytest.approx(1 / 3) and d.recall_3 == 1.0 and d.ndcg_3 > 1  # duplicates inflate NDCG only
    e = per_case(spark, [1], [], (3,))
    assert (e.precision_3, e.recall_3, e.ndcg_3, e.rr) == (0.0, 0.0, 0.0, 0.0)


def unit(n, d, seed):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vec_df(spark, m, name, base=0):
    return spark.createDataFrame([(base + i, [float(x) for x in row]) for i, row in enumerate(m)], f"{name} bigint, vector array<double>")


def test_blocked_search_equals_full_product(spark):
    q, m = unit(37, 8, 1), unit(301, 8, 2)
    m[7] = m[3]  # equal vectors: the lower id goes first
    params = replace(RetrievalParams(), item_block_rows=40, query_chunk_rows=10)
    hits = retrieval.exact_topk(vec_df(spark, q, "query_id"), vec_df(spark, m, "item_id"), 12, params).collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.query_id, h["rank"])):
        got.setdefault(h.query_id, []).append(h.item_id)
    for i in range(len(q)):
        want = sorted(range(len(m)), key=lambda j: (-round(float(m[j] @ q[i]), 12), j))[:12]
        assert got[i] == want


def test_restricted_search_returns_only_allowed_and_caps_k(spark):
    allowed = spark.createDataFrame([(3,), (5,), (99,)], "item_id bigint")
    hits = retrieval.exact_topk(vec_df(spark, unit(2, 8, 1), "query_id"), vec_df(spark, unit(10, 8, 2), "item_id"), 50, allowed=allowed).collect()
    assert {h.item_id for h in hits} == {3, 5} and len(hits) == 4
    with pytest.raises(ValueError):
        retrieval.exact_topk(vec_df(spark, unit(1, 8, 1), "query_id"), vec_df(spark, unit(3, 8, 2), "item_id"), 0)


def test_a_compiled_perceptron_scores_like_the_fitted_one(spark):
    rng = np.random.default_rng(6)
    data = [(float(int(a + 2 * b - c > 0)), float(a), float(3 * b + 1), float(c), 5.0) for a, b, c in rng.normal(size=(300, 3))]
    df = spark.createDataFrame(data, "label double, a double, b double, c double, flat double")
    net = MultilayerPerceptronClassifier(layers=[4, 6, 3, 2], maxIter=15, seed=1)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c", "flat"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), net]).fit(df)
    both = model.transform(df).select(vector_to_array("probability")[1].alias("p"), perceptron.compiled(model).score([F.col(c) for c in ("a", "b", "c", "flat")]).alias("q")).collect()
    assert all(r.p == pytest.approx(r.q, abs=1e-9) for r in both) and len({r.q for r in both}) > 100
    with pytest.raises(ValueError):
        perceptron.compiled(model).score([F.col("a")])


def test_auc_counts_pairs_with_ties(spark):
    rng = np.random.default_rng(7)
    rows = [(float(s), int(y)) for s, y in zip(rng.integers(0, 12, 200) / 4, rng.integers(0, 2, 200))]
    got = metrics.auc(spark.createDataFrame(rows + [(None, 1)], "s double, y int"), "s", "y").first()
    pairs = [(a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z]
    assert got.auc == pytest.approx(np.mean(pairs)) and got.positives * got.negatives == len(pairs)
    assert metrics.auc(spark.createDataFrame([(1.0, 1)], "s double, y int"), "s", "y").first().auc is None


def test_factors_of_ids_beyond_32_bits(spark):
    rows = [((1 << 40) + u, (1 << 35) + p, "PURCHASE") for u in range(12) for p in range(10) if (u + p) % 2 == 0]
    users, items = ranker.interaction_factors(spark.createDataFrame(rows, "user_id bigint, product_id bigint, action_type string"), rank=4)
    u, i = ({r[0]: np.array(r[1]) for r in df.collect()} for df in (users, items))
    assert set(u) == {r[0] for r in rows} and set(i) == {r[1] for r in rows}
    bought = {(a, b) for a, b, _ in rows}
    mean = lambda own: np.mean([u[a] @ i[b] for a in u for b in i if ((a, b) in bought) == own])
    assert mean(True) > mean(False) + 0.3


def test_bounded_search_equals_full_search_with_less_work(spark):
    centres = unit(24, 16, 3)
    m = centres[np.arange(2400) % 24] + np.random.default_rng(4).normal(size=(2400, 16)) * 0.03
    m[[5, 700]] = 0  # without a direction
    m[9] = m[33]
    items = vec_df(spark, m, "item_id").unionByName(spark.createDataFrame([(9999, None)], "item_id bigint, vector array<double>"))
    q = np.vstack([m[:60], unit(5, 16, 8), np.zeros((1, 16))])
    params = replace(RetrievalParams(), item_block_rows=40, query_chunk_rows=10)
    allowed = items.where("item_id % 7 <> 3").select("item_id")
    for limit, some in ((12, None), (70, allowed)):
        hits, visits = retrieval.bounded_topk(vec_df(spark, q, "query_id"), items, limit, params, some)
        want = retrieval.exact_topk(vec_df(spark, q, "query_id"), items, limit, replace(params, item_block_rows=10_000), allowed=some)
        key = lambda df: sorted((h.query_id, h["rank"], h.item_id, round(h.score, 9)) for h in df.collect())
        assert key(hits) == key(want)
        work = visits.where("query_id < 60").agg(F.sum("items")).first()[0]
        assert work < 0.4 * 60 * len(m)
    for n in (0, 1, 3):  # fewer items than asked for, and none
        few = items.where(F.col("item_id") < n)
        assert retrieval.bounded_topk(vec_df(spark, q[:4], "query_id"), few, 12, params)[0].count() == 4 * n
    same = retrieval.nearest_items(vec_df(spark, q, "query_id"), items, 12, params)
    assert {(h.query_id, h["rank"], h.item_id) for h in same.collect()} == {(h.query_id, h["rank"], h.item_id) for h in retrieval.nearest_items(vec_df(spark, q, "query_id"), items, 12).collect()}


def test_search_of_evenly_spread_vectors_sends_each_query_once_a_pass(spark, monkeypatch):
    m = unit(900, 16, 5)
    m[100:400] = m[100]  # copies: the lowest ids stay
    items, q = vec_df(spark, m, "item_id"), np.vstack([m[95:105], unit(20, 16, 6), np.zeros((2, 16))])
    sent = []

    def counted(df, name):
        out = stage(df, name)
        if {"query_id", "vector"} <= set(out.columns):
            sent.append(out.count())
        return out

    monkeypatch.setattr(retrieval, "stage", counted)
    params = replace(RetrievalParams(), item_block_rows=50, query_chunk_rows=4)
    unit_q = q / np.clip(np.linalg.norm(q, axis=1, keepdims=True), 1e-12, None)
    scores = np.round(unit_q @ m.T, 9)
    want = {(i, n + 1, int(j)) for i, row in enumerate(scores) for n, j in enumerate(np.lexsort((np.arange(len(m)), -row))[:7])}
    for hits in (retrieval.bounded_topk(vec_df(spark, q, "query_id"), items, 7, params)[0], retrieval.exact_topk(vec_df(spark, q, "query_id"), items, 7, params)):
        assert {(h.query_id, h["rank"], h.item_id) for h in hits.collect()} == want
    assert len(sent) == 2 and max(sent) <= len(q)


def test_cell_search_recall(spark):
    centres = unit(12, 16, 3)
    noise = np.random.default_rng(4).normal(size=(600, 16)) * 0.15
    m = centres[np.arange(600) % 12] + noise
    items, queries = vec_df(spark, m, "item_id"), vec_df(spark, m[:50], "query_id")
    params = replace(RetrievalParams(), item_block_rows=25)  # cells larger than a block are split
    near = retrieval.cell_topk(queries, items, 10, params)
    exact = retrieval.exact_topk(queries, items, 10, params)
    both = near.join(exact.select("query_id", "item_id"), ["query_id", "item_id"]).count()
    assert both / exact.count() > 0.9
    assert near.where("rank = 1 AND query_id = item_id").count() == 50


def test_vectors_that_are_not_finite_fail_the_search(spark):
    good = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "query_id bigint, vector array<double>")
    for bad in ([float("nan"), 1.0], [1.0, float("inf")], [None, 1.0]):
        items = good.withColumnRenamed("query_id", "item_id").union(spark.createDataFrame([(9, bad)], "item_id bigint, vector array<double>"))
        with pytest.raises(Exception, match="not finite"):
            retrieval.exact_topk(good, items, 2).collect()


def test_cell_search_of_few_items(spark):
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "item_id bigint, vector array<double>")
    assert retrieval.cell_topk(items.withColumnRenamed("item_id", "query_id"), items, 2).count() == 6


def test_pool_size():
    p = RetrievalParams()
    assert [retrieval.pool_size(p, n, c) for n, c in ((10, 1000), (20, 1000), (10, 30))] == [50, 100, 30]
    with pytest.raises(ValueError):
        retrieval.pool_size(p, 0, 10)


def test_tiers_and_rank_scores(spark):
    df = spark.createDataFrame([(0,), (1,), (4,), (5,)], "n int")
    assert [r[0] for r in df.select(candidates.history_tier(F.col("n"), DEFAULTS.cold_start)).collect()] == ["no_history", "sparse", "sparse", "strong"]
    s = spark.createDataFrame([(1, 3), (2, 3), (3, 3), (1, 1)], "r int, n int").select(ranks.rank_score(F.col("r"), F.col("n"))).collect()
    assert [x[0] for x in s] == [1.0, 0.5, 0.0, 1.0]


SOURCES = "u int, source_order int, source string, weight double, product_id bigint, rank int, list_size int"


def test_blend_keeps_the_best_source(spark):
    rows = [(1, 0, "personalized", 0.5, 10, 1, 1), (1, 1, "popularity", 0.9, 10, 1, 1)]
    out = candidates.blend(spark.createDataFrame(rows, SOURCES), "u", 5).collect()
    assert [(r.product_id, r.source, r.score) for r in out] == [(10, "popularity", 0.9)]
    tie = [(1, 0, "a", 0.5, 10, 1, 1), (1, 1, "b", 0.5, 10, 1, 2), (1, 1, "b", 0.5, 11, 2, 2)]
    out = candidates.blend(spark.createDataFrame(tie, SOURCES), "u", 5).orderBy("position").collect()
    assert [(r.product_id, r.source) for r in out] == [(10, "a"), (11, "b")]


def test_waterfall_takes_new_ids_until_full(spark):
    rows = [(1, 0, "a", 1.0, 10, 1, 2), (1, 0, "a", 1.0, 11, 2, 2), (1, 1, "b", 1.0, 11, 1, 2), (1, 1, "b", 1.0, 20, 2, 2)]
    df = spark.createDataFrame(rows, SOURCES)
    assert [r.product_id for r in candidates.waterfall(df, "u", 9).orderBy("position").collect()] == [10, 11, 20]
    assert [r.product_id for r in candidates.waterfall(df, "u", 2).orderBy("position").collect()] == [10, 11]


CANDS = "u bigint, position bigint, product_id bigint, score double, source string, category_name string, brand string"


def greedy(rows, p):
    left, out, cats, brands = list(rows), [], {}, {}
    while left:
        best = max(range(len(left)), key=lambda i: (left[i][3] - p.diversity_strength * (cats.get(left[i][5], 0) * p.category_repetition_penalty + brands.get(left[i][6], 0) * p.brand_repetition_penalty), -i))
        c = left.pop(best)
        out.append(c[2])
        if c[5]:
            cats[c[5]] = cats.get(c[5], 0) + 1
        if c[6]:
            brands[c[6]] = brands.get(c[6], 0) + 1
    return out


def test_diversity_golden_and_against_plain_loop(spark):
    p = Reranking(diversity_strength=1.0, category_repetition_penalty=0.5, brand_repetition_penalty=0.0)
    rows = [(1, 1, 1, 0.90, "s", "Dairy", "a"), (1, 2, 2, 0.89, "s", "Dairy", "b"), (1, 3, 3, 0.85, "s", "Snacks", "c")]
    out = rerank.rerank(spark.createDataFrame(rows, CANDS), "u", p).orderBy("rank").collect()
    assert [r.product_id for r in out] == [1, 3, 2]
    rng = np.random.default_rng(9)
    many = [(u, i + 1, 100 * u + i, float(np.round(rng.random(), 2)), "s", rng.choice(["x", "y", None]), rng.choice(["b1", "b2", None])) for u in range(30) for i in range(1 + u)]
    got = {}
    for r in rerank.rerank(spark.createDataFrame(many, CANDS), "u", Reranking()).orderBy("u", "rank").collect():
        got.setdefault(r.u, []).append(r.product_id)
    for u in range(30):
        assert got[u] == greedy([c for c in many if c[0] == u], Reranking())


def test_deduplicate_keeps_the_first(spark):
    rows = [(1, 1, 5, 0.9, "a", "x", "y"), (1, 2, 5, 0.8, "b", "x", "y"), (1, 3, 6, 0.7, "a", "x", "y")]
    out = rerank.deduplicate(spark.createDataFrame(rows, CANDS), "u").orderBy("position").collect()
    assert [(r.product_id, r.source) for r in out] == [(5, "a"), (6, "a")]


PRODUCTS = ("product_id bigint, category_name string, brand string, price double, effective_price double, discount_percentage double, is_active boolean, stock_quantity int, is_discounted boolean,"
            "price_tier string, category_relative_price double, purchase_count bigint, cart_add_count bigint, review_count bigint, average_rating double, max_price double, eligible boolean, name string")


def store(spark, active=None):
    """Products 1-12 eligible over four categories and three brands, 13 inactive, 14 out of stock."""
    rows = []
    for i in range(1, 15):
        on, stock = (i != 13) if active is None else active(i), 0 if i == 14 else 5
        rows.append((i, f"cat{i % 4}", f"brand{i % 3}", 10.0 + i, 10.0 + i, 0.0, on, stock, False, "mid", 0.5, 100 - i, i % 5, 0, None, 24.0, on and stock > 0, f"p{i}"))
    return spark.createDataFrame(rows, PRODUCTS)


def feats(spark, rows):
    return spark.createDataFrame(rows, "example_id bigint, user_id bigint, total_engagement_events bigint, preferred_category string, top_category string, vector array<double>")


def serve_all(spark, products=None, final=None, top_n=5):
    emb = vec_df(spark, unit(14, 4, 7), "product_id", 1).withColumnRenamed("vector", "embedding")
    cat = Catalog(products if products is not None else store(spark), None, None, None)
    f = feats(spark, [(1, 1, 9, "cat1", "cat1", [1.0, 0.0, 0.0, 0.0]), (2, 2, 2, "cat2", "cat2", [0.0, 1.0, 0.0, 0.0]), (3, 3, 0, "cat3", "cat3", None), (4, 4, 0, None, None, None), (5, 5, 0, "cat3", "cat3", None)])
    return serve.recommend(f, cat, emb, DEFAULTS, top_n, final_catalog=final)


def test_serving_tiers_gate_and_counters(spark):
    rec = serve_all(spark)
    items = rec.items.collect()
    by = {}
    for r in sorted(items, key=lambda r: (r.example_id, r["rank"])):
        by.setdefault(r.example_id, []).append(r)
    assert set(by) == {1, 2, 3, 4, 5}
    assert all(len(v) == 5 and len({r.product_id for r in v}) == 5 and [r["rank"] for r in v] == [1, 2, 3, 4, 5] for v in by.values())
    assert not {13, 14} & {r.product_id for r in items}
    assert {r.source for r in by[1]} == {"personalized"}
    assert {r.source for r in by[2]} <= {"personalized", "preferred_category", "popularity"}
    assert {r.source for r in by[4]} == {"global_popularity"} and by[3][0].source in ("preferred_category", "global_popularity")
    assert [r.product_id for r in by[3]] == [r.product_id for r in by[5]]
    meta = {r.example_id: r for r in rec.meta.collect()}
    assert (meta[1].tier, meta[2].tier, meta[3].tier) == ("strong", "sparse", "no_history")
    assert all((m.pool_size, m.num_excluded_pre_retrieval, m.num_excluded_by_eligibility, m.fill_rate) == (12, 2, 0, 1.0) for m in meta.values())


def test_final_check_catches_products_gone_since_retrieval(spark):
    first = {r.product_id for r in serve_all(spark).items.where("example_id = 4").collect()}
    gone = min(first)
    rec = serve_all(spark, final=store(spark, active=lambda i: i not in (13, gone)))
    assert gone not in {r.product_id for r in rec.items.collect()}
    assert rec.meta.where("example_id = 4").first().num_excluded_by_eligibility == 1


def test_no_eligible_products_and_short_catalogs(spark):
    rec = serve_all(spark, products=store(spark, active=lambda i: False))
    assert rec.items.count() == 0 and {r.fill_rate for r in rec.meta.collect()} == {0.0}
    few = serve_all(spark, products=store(spark, active=lambda i: i in (1, 2)))
    assert {r.returned for r in few.meta.collect()} == {2}


def test_rules_for_unknown_products_and_without_rules(spark):
    ids = spark.createDataFrame([(1,), (13,), (14,), (77,)], "product_id bigint")
    got = {r.product_id: r.reasons for r in eligibility.apply_rules(ids, "product_id", store(spark), EligibilityParams()).collect()}
    assert got == {1: [], 13: ["is_active"], 14: ["in_stock"], 77: ["is_active", "in_stock"]}
    assert eligibility.apply_rules(ids, "product_id", store(spark), EligibilityParams(False, False)).where("eligible").count() == 4


def test_ranking_feature_contract(spark):
    assert len(ranking.FEATURES) == 29 and len(set(ranking.FEATURES)) == 29
    ranking.check_feature_columns(list(ranking.FEATURES))
    with pytest.raises(ValueError, match="other features"):
        ranking.check_feature_columns(list(reversed(ranking.FEATURES)))


def test_missing_positive_gets_the_worst_score_and_rank(spark):
    hits = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.2, 2)], "query_id bigint, item_id bigint, score double, rank bigint")
    want = spark.createDataFrame([(1, 6), (1, 7), (2, 7)], "example_id bigint, product_id bigint")
    got = {(r.example_id, r.product_id): (r.retrieval_score, r.retrieval_rank) for r in ranking.score_and_rank(want, hits).collect()}
    assert got == {(1, 6): (0.2, 1), (1, 7): (0.2, 2), (2, 7): (0.0, 0)}


def test_negatives_are_never_purchased(spark):
    hits = spark.createDataFrame([(1, i, 1.0 - i / 100, i + 1) for i in range(20)], "query_id bigint, item_id bigint, score double, rank bigint")
    want = spark.createDataFrame([(1, 8, 3, 4)], "example_id bigint, user_id bigint, salt bigint, needed bigint")
    bought = spark.createDataFrame([(8, i) for i in range(10)], "user_id bigint, product_id bigint")
    got = [r.product_id for r in ranking.retrieved_negatives(hits, want, bought, 42).collect()]
    assert len(got) == len(set(got)) == 4 and min(got) >= 10


def report_rows(spark):
    return spark.createDataFrame([(s, 3, "mrr", 0, 0.5) for s in ("val", "test")], "split string, cases bigint, metric string, k bigint, value double")


WHO = {"run_id": "r1", "ranker_model_version": "a", "retrieval_model_version": "b", "data_source": "events", "dataset_fingerprint": "f"}


def test_report_roundtrip_and_provenance(spark):
    path = f"{stage_root(spark)}/report-ok"
    reports.save(reports.build(report_rows(spark), WHO, 10, None, "2024-01-01T00:00:00"), path)
    report = reports.load(spark, path)
    assert report.count() == 2
    reports.validate(report, WHO)
    assert {m.field for m in reports.mismatches(report, {**WHO, "run_id": "", "dataset_fingerprint": "x"}).collect()} == {"run_id", "dataset_fingerprint"}
    with pytest.raises(reports.ReportMismatch, match="run_id"):
        reports.validate(report, {**WHO, "run_id": "r2"})


def test_report_missing_and_malformed(spark):
    with pytest.raises(reports.ReportMissing):
        reports.load(spark, f"{stage_root(spark)}/nowhere")
    path = f"{stage_root(spark)}/report-half"
    reports.save(reports.build(report_rows(spark).where("split = 'val'"), WHO, 10, 21.0, "t"), path)
    with pytest.raises(reports.ReportMalformed):
        reports.load(spark, path)
    bad = f"{stage_root(spark)}/report-bad"
    spark.createDataFrame([("not json",)], "v string").write.mode("overwrite").text(bad)
    with pytest.raises(reports.ReportMalformed):
        reports.load(spark, bad)


def test_embedding_refresh_reuses_what_fits(spark):
    texts = spark.createDataFrame([(1, "red ring"), (2, "blue bolt"), (3, "green gear")], "product_id bigint, text string")
    enc = fit_hashing_encoder(texts.select("text"), 16)
    first, changed = embedding_store.refresh(texts, None, enc, "hash")
    path = f"{stage_root(spark)}/vectors"
    embedding_store.save(first, path, "hash")
    stored = embedding_store.load(spark, path)
    assert changed and stored.count() == 3
    again, changed = embedding_store.refresh(texts, stored, enc, "hash")
    assert not changed and again.count() == 3
    edited = texts.where("product_id < 3").withColumn("text", F.when(F.col("product_id") == 2, "blue bolts").otherwise(F.col("text")))
    actions = embedding_store.plan_refresh(edited.withColumn("content_hash", F.substring(F.sha2("text", 256), 1, 16)), stored, "hash")
    assert {r.product_id: r.action for r in actions.collect()} == {1: "keep", 2: "encode", 3: "drop"}
    new, changed = embedding_store.refresh(edited, stored, enc, "hash")
    assert changed and {r.product_id for r in new.collect()} == {1, 2}
    assert embedding_store.refresh(texts, stored, enc, "other model")[1]


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    a, b = (snapshots.fingerprint(df.repartition(n)).first().fingerprint for n in (1, 7))
    assert a == b and len(a) == 16 and snapshots.fingerprint(df.withColumn("x", F.lit(1))).first().fingerprint != a


def test_in_batch_ties_at_nine_digits_go_to_the_lowest_row(spark):
    rows = [(0, [1.0, 0.0], [1.0, 1e-7]), (1, [1.0, 0.0], [1.0, 0.0]), (2, [0.0, 1.0], [0.0, 1.0])]
    pairs = spark.createDataFrame(rows, "row_id bigint, user_vector array<double>, item_vector array<double>")
    assert {r.row_id: r.hit for r in encode.in_batch_softmax(pairs, 1, 0.05).collect()} == {0: True, 1: False, 2: True}


def test_snapshots_are_compressed_and_come_back_whole(spark, tmp_path):
    rows = spark.range(5000).select("id", F.concat(F.lit("name "), F.col("id") % 7).alias("name"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("part")).repartition(3)
    snapshots.save({"rows": rows}, str(tmp_path / "packed"))
    rows.write.json(str(tmp_path / "plain"))
    packed, plain = (sum(p.stat().st_size for p in (tmp_path / d).rglob("part-*")) for d in ("packed/rows", "plain"))
    assert packed * 3 < plain
    back = snapshots.read(spark, str(tmp_path / "packed"), {"rows": rows.schema})["rows"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_the_gradient_of_the_network_is_that_of_its_loss():
    rng = np.random.default_rng(3)
    x, second, flat = rng.normal(size=(40, 3)), rng.random(40) < 0.4, rng.normal(size=5 * 4 + 2 * 6)
    value = lambda w: perceptron._loss_and_gradient(x, second, perceptron._unpacked(w, [3, 5, 2]))
    _, g = value(flat)
    for i in range(len(flat)):
        e = np.zeros(len(flat))
        e[i] = 1e-6
        assert g[i] == pytest.approx((value(flat + e)[0] - value(flat - e)[0]) / 2e-6, abs=1e-4)


def test_a_fit_in_tasks_is_as_good_as_the_library_s_and_knows_no_partitions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 3))
    data = [(int(a * b > 0.2 * c), float(a), float(3 * b + 1), float(c), 5.0) for a, b, c in x]
    df, inputs = spark.createDataFrame(data, "label int, a double, b double, c double, flat double"), ["a", "b", "c", "flat"]
    loss = lambda pairs: np.mean([-np.log(max(p if y else 1 - p, 1e-12)) for y, p in pairs])
    net = MultilayerPerceptronClassifier(layers=[4, 12, 6, 2], maxIter=40, seed=1)
    old = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), net]).fit(df)
    theirs = loss([(r.label, r.p) for r in old.transform(df).select("label", vector_to_array("probability")[1].alias("p")).collect()])
    for parts in (1, 7):
        model = perceptron.fit(df.repartition(parts), inputs, "label", (12, 6), 40, 1)
        ours = loss([(r.label, r.model_score) for r in model.scored(df, inputs, ["label"]).collect()])
        assert ours < 1.15 * theirs + 0.02
    both = model.scored(df.withColumn("q", model.score([F.col(c) for c in inputs])), inputs, ["q"]).collect()
    assert all(r.model_score == pytest.approx(r.q, abs=1e-9) for r in both)
    with pytest.raises(Exception, match="NULL"):
        model.scored(df.withColumn("b", F.lit(None).cast("double")), inputs, ["label"]).collect()


def test_the_served_model_builds_case_features_once(spark, monkeypatch):
    calls = []
    history = evaluate.case_history
    monkeypatch.setattr(evaluate, "case_history", lambda *a, **k: calls.append(1) or history(*a, **k))
    ranking_queries.served_with_model(bindings.load(spark, "/root/testdata/sf0.001"))
    assert len(calls) == 1


def test_a_sample_goes_on_where_its_first_draws_are_bought(spark):
    """Every sample is the start of the draws of the whole list without purchases, also where more than the spare draws are bought."""
    hits = spark.createDataFrame([(q, i, 1.0 - i / 100, i + 1) for q in (1, 2, 3) for i in range(40)], "query_id bigint, item_id bigint, score double, rank bigint")
    want = spark.createDataFrame([(q, 10 + q, s, salt, n) for q, s, salt, n in ((1, "a", 0, 4), (1, "b", 1, 4), (2, "a", 0, 60), (3, "a", 0, 4))],
                                 "example_id bigint, user_id bigint, split string, salt int, needed bigint")
    draws = {(q, s): sorted(range(40), key=lambda i: (hashlib.md5(f"42:{10 + q}:{salt}:{i}".encode()).hexdigest(), i)) for q, s, salt in ((1, "a", 0), (1, "b", 1), (2, "a", 0), (3, "a", 0))}
    bought = {(11, i) for i in draws[1, "a"][:15]} | {(12, 7)} | {(13, i) for i in range(40) if i != draws[3, "a"][39]}
    got = ranking.retrieved_negatives(hits, want, spark.createDataFrame(sorted(bought) * 2, "user_id bigint, product_id bigint"), 42, ("split",)).collect()
    for (q, s), order in draws.items():
        free = [i for i in order if (10 + q, i) not in bought][:60 if q == 2 else 4]
        assert {r.product_id for r in got if (r.example_id, r.split) == (q, s)} == set(free)
    assert len(got) == 4 + 4 + 39 + 1


def test_packed_rows_come_back(spark):
    x = np.arange(3 * 130, dtype=np.float32).reshape(130, 3)
    packed = perceptron._packed(x)
    assert len(packed) == 3 and (perceptron._unpacked_rows(packed, np.float32).reshape(-1, 3) == x).all()
    assert (perceptron._unpacked_rows(packed.slice(1), np.float32).reshape(-1, 3) == x[64:]).all()
    df = spark.createDataFrame([(float(i), 7.0, float(i % 3)) for i in range(100)], "a double, b double, c double")
    n, mean, spread = perceptron._moments(df.repartition(7), ["a", "b", "c"])
    want = np.array([(i, 7.0, i % 3) for i in range(100)])
    assert n == 100 and np.allclose(mean, want.mean(axis=0)) and np.allclose(spread, want.std(axis=0, ddof=1))
