"""Golden rows for prices, decay, affinities, vectors and product features."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import pricing, recency, text, vectors
from shelfwise.operators import affinity, catalog, history
from shelfwise.params import FeatureParams, Recency

T0 = datetime(2024, 3, 1)
CATALOG = "product_id bigint, category_name string, brand string, effective_price double"
EVENTS = "event_id bigint, user_id bigint, product_id bigint, action_type string, action_time timestamp_ntz"


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


def shop(spark):
    return spark.createDataFrame([(1, "Dairy & Eggs", "A", 2.0), (2, "Snacks", "B", 4.0), (3, "Dairy & Eggs", "B", 6.0)], CATALOG)


def no_users(spark):
    return spark.createDataFrame([], "user_id bigint, preferred_category string, age_group string")


def hist_of(spark, rows, as_of=None, params=Recency()):
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENTS)
    ref = F.lit(as_of).cast("timestamp_ntz") if as_of else None
    return history.live_history(history.signals(events), params, ref)


def weights(df):
    return {r["name"]: round(r["weight"], 9) for r in df.collect()}


@pytest.mark.parametrize("price,sale,want,flag", [(10.0, None, 10.0, False), (10.0, 8.0, 8.0, True), (10.0, 12.0, 10.0, False), (10.0, 10.0, 10.0, False), (10.0, 0.0, 10.0, False)])
def test_effective_price(spark, price, sale, want, flag):
    df = spark.createDataFrame([(price, sale)], "price double, sale double")
    row = df.select(pricing.effective_price(F.col("price"), F.col("sale")).alias("p"), pricing.is_discounted(F.col("price"), F.col("sale")).alias("d")).first()
    assert (row.p, row.d) == (want, flag)


def test_price_tiers(spark):
    df = spark.createDataFrame([(5.0,), (10.0,), (15.0,), (20.0,), (20.01,)], "p double")
    assert col(df, pricing.price_tier(F.col("p"), F.lit(10.0), F.lit(20.0))) == ["budget", "budget", "mid", "mid", "premium"]


def test_category_relative_price(spark):
    df = spark.createDataFrame([(1, "Cereal", "x", 20.0), (2, "Cereal", "x", 5.0), (3, "Meat", "x", 20.0), (4, "Meat", "x", 50.0), (5, "Solo", "x", 9.0), (6, None, "x", 9.0)], CATALOG)
    got = {(r.category_name, r.effective_price): r.category_relative_price for r in catalog.category_relative_price(df).collect()}
    assert got == {("Cereal", 20.0): 1.0, ("Cereal", 5.0): 0.5, ("Meat", 20.0): 0.5, ("Meat", 50.0): 1.0, ("Solo", 9.0): 0.5}


def test_price_context(spark):
    df = spark.createDataFrame([(1, "A", "x", 2.0), (2, "A", "x", 4.0), (3, "B", "x", 6.0)], CATALOG)
    ctx = catalog.price_context(df.withColumn("price", F.col("effective_price"))).first()
    per = {r.category_name: (r.category_median, r.category_std) for r in catalog.category_prices(df).collect()}
    assert ctx.median_price == 4.0 and per["A"] == (3.0, 1.0) and per["B"] == (6.0, 0.0)
    empty = catalog.price_context(df.withColumn("price", F.col("effective_price")).where("false")).first()
    assert (empty.tier_lower, empty.tier_upper) == (0.0, 0.0)


def test_decay_values_and_future_guard(spark):
    ages = spark.createDataFrame([(T0 - timedelta(days=d),) for d in (0, 21, 42, 63)], "ts timestamp_ntz")
    ref = F.lit(T0).cast("timestamp_ntz")
    assert col(ages, recency.decay(F.col("ts"), ref, 21.0)) == [1.0, 0.5, 0.25, 0.125]
    later = spark.createDataFrame([(T0 + timedelta(seconds=1),)], "ts timestamp_ntz")
    with pytest.raises(Exception, match="later than reference"):
        later.select(recency.decay(F.col("ts"), ref, 21.0)).collect()
    with pytest.raises(ValueError):
        Recency(half_life_days=0)


def test_weight_is_neutral_without_time_reference_or_decay(spark):
    df = spark.createDataFrame([(None,), (T0 - timedelta(days=21),)], "ts timestamp_ntz")
    ref = F.lit(T0).cast("timestamp_ntz")
    assert col(df, recency.effective_weight(0.4, F.col("ts"), ref, Recency())) == [0.4, 0.2]
    assert col(df, recency.effective_weight(0.4, F.col("ts"), None, Recency())) == [0.4, 0.4]
    assert col(df, recency.effective_weight(0.4, F.col("ts"), ref, Recency(enabled=False))) == [0.4, 0.4]


def test_affinity_blends_signals(spark):
    p = FeatureParams(purchase_weight=0.8, cart_weight=0.2)
    hist = hist_of(spark, [(1, 1, "PURCHASE", None), (1, 2, "ADD_TO_CART", None)])
    ex = spark.createDataFrame([(1, 1)], "example_id bigint, user_id bigint")
    assert weights(affinity.category_affinity(hist, shop(spark), ex, no_users(spark), p)) == {"Dairy & Eggs": 0.8, "Snacks": 0.2}


def test_quantity_scales_affinity(spark):
    hist = spark.createDataFrame([(1, 1, "purchase", 1, 1, 1.0, 3.0), (1, 1, "purchase", 2, 1, 1.0, 1.0)],
                                 "example_id bigint, user_id bigint, signal string, product_id bigint, n bigint, w double, qty double")
    got = weights(affinity.top_normalised(affinity.contributions(hist, shop(spark), "category_name", FeatureParams()), 5))
    assert got == {"Dairy & Eggs": 0.75, "Snacks": 0.25}


def test_truncation_precedes_normalisation(spark):
    c = spark.createDataFrame([(1, "a", 5.0), (1, "b", 3.0), (1, "c", 2.0)], "example_id bigint, name string, v double")
    assert weights(affinity.top_normalised(c, 2)) == {"a": 0.625, "b": 0.375}


def test_vector_blend_and_missing_signals(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0])], "product_id bigint, embedding array<float>")
    p = FeatureParams(purchase_weight=0.75, cart_weight=0.25)
    both = hist_of(spark, [(1, 1, "PURCHASE", None), (1, 2, "ADD_TO_CART", None), (2, 1, "PURCHASE", None), (3, 99, "PURCHASE", None)])
    got = {r.example_id: r.vector for r in affinity.user_vectors(affinity.signal_vectors(both, emb, p, 4), 4).collect()}
    assert got == {1: [0.75, 0.25, 0.0, 0.0], 2: [1.0, 0.0, 0.0, 0.0]}


def test_event_volume_does_not_change_the_blend(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "product_id bigint, embedding array<float>")
    p = FeatureParams(purchase_weight=0.5, cart_weight=0.5)
    hist = hist_of(spark, [(1, 1, "PURCHASE", None)] + [(1, 2, "ADD_TO_CART", None)] * 9)
    assert affinity.user_vectors(affinity.signal_vectors(hist, emb, p, 2), 2).first().vector == [0.5, 0.5]


def test_decay_shifts_affinity_and_vector_to_recent_items(spark):
    old, new = T0 - timedelta(days=63), T0
    hist = hist_of(spark, [(1, 1, "PURCHASE", old), (1, 2, "PURCHASE", new)], as_of=T0)
    ex = spark.createDataFrame([(1, 1)], "example_id bigint, user_id bigint")
    got = weights(affinity.category_affinity(hist, shop(spark), ex, no_users(spark), FeatureParams()))
    assert got["Snacks"] == pytest.approx(8 / 9) and sum(got.values()) == pytest.approx(1)


def test_chatbot_mentions_share_the_latest_time(spark):
    hist = hist_of(spark, [(1, 1, "CHATBOT", T0 - timedelta(days=42)), (1, 2, "CHATBOT", T0 - timedelta(days=21))], as_of=T0)
    assert sorted(col(hist, "w")) == [0.5, 0.5]
    counts = history.engagement_counts(hist, spark.createDataFrame([(1, 1), (2, 2)], "example_id bigint, user_id bigint"))
    got = {r.user_id: (r.has_chatbot_context, r.total_engagement_events) for r in counts.collect()}
    assert got == {1: (True, 1), 2: (False, 0)}


def test_unknown_action_type_fails_the_load(spark):
    df = spark.createDataFrame([(1, 1, 1, "WISH", T0)], EVENTS)
    with pytest.raises(Exception, match="unknown action type"):
        history.signals(df).collect()
    assert history.signals(df, strict=False).count() == 0 and history.reject_unknown_actions(df).count() == 1


def test_price_profile_fallbacks(spark):
    cat = spark.createDataFrame([(1, "A", "x", 2.0), (2, "A", "x", 4.0), (3, "B", "x", 12.0)], CATALOG).withColumn("price", F.col("effective_price"))
    users = spark.createDataFrame([(1, None, None), (2, "A", None), (3, None, None)], "user_id bigint, preferred_category string, age_group string")
    ex = users.select(F.col("user_id").alias("example_id"), "user_id")
    hist = hist_of(spark, [(1, 1, "PURCHASE", T0 - timedelta(days=21)), (1, 3, "PURCHASE", T0)], as_of=T0)
    prof = affinity.price_profiles(affinity.price_summary(affinity.purchase_prices(hist, cat)), ex, users, cat, catalog.price_context(cat), catalog.category_prices(cat))
    got = {r.user_id: (round(r.typical_price, 6), round(r.price_spread, 6), r.supporting_purchase_count, r.fallback_source) for r in prof.collect()}
    assert got[1] == (round((2 * 0.5 + 12) / 1.5, 6), 5.0, 2, "purchase_history")
    assert got[2] == (3.0, 1.0, 0, "preferred_category_prior")
    assert got[3][0] == 4.0 and got[3][3] == "catalog_prior"


def test_relative_distance(spark):
    df = spark.createDataFrame([(15.0, 10.0), (15.0, None)], "c double, u double")
    assert col(df, pricing.relative_distance(F.col("c"), F.col("u"))) == [0.5, 0.0]


def test_product_text_skips_missing_parts(spark):
    df = spark.createDataFrame([("Milk", "Acme", "Dairy", "Food", ["a", "b"], None, "  "), (" Nut ", None, None, "Food", [], "tasty", "nuts")],
                               "n string, b string, c string, p string, t array<string>, d string, i string")
    got = col(df, text.product_text(*[F.col(c) for c in "nbcptdi"]))
    assert got[0].startswith("Milk Brand: Acme. Category: Food > Dairy. Tags: a, b.") and got[1] == "Nut tasty Ingredients: nuts."


def test_slug_and_cosine(spark):
    df = spark.createDataFrame([("Chili & Lime!", [1.0, 0.0], [1.0, 1.0], None, [0.0, 0.0])], "s string, a array<double>, b array<double>, c array<double>, z array<double>")
    row = df.select(text.slug(F.col("s")).alias("s"), vectors.cosine(F.col("a"), F.col("b")).alias("ab"), vectors.cosine(F.col("a"), F.col("c")).alias("ac"),
                    vectors.cosine(F.col("a"), F.col("z")).alias("az"), vectors.has_cosine(F.col("a"), F.col("z")).alias("hz"), vectors.l2_normalise(F.col("b")).alias("u")).first()
    assert row.s == "chili-lime" and row.ab == pytest.approx(0.70710678) and (row.ac, row.az, row.hz) == (0.0, 0.0, False) and row.u[0] == pytest.approx(0.70710678)
