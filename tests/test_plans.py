"""Plan shape: no pairwise joins, pushed filters, pruned columns, limits before shuffles."""

import os

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfwise.operators import affinity, candidates, catalog, history, orders, temporal
from shelfwise.params import DEFAULTS
from shelfwise.plans import features
from shelfwise.sources import bindings
from shelfwise.sources.stage import stage

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def t(spark):
    return bindings.load(spark, ROOT)


@pytest.mark.parametrize("name", ["recommendations", "case_top20_cosine", "temporal_train_affinity", "loo_category_affinity", "price_neighbours",
                                  "foreign_key_report", "text_mentions", "product_features", "user_price_profile", "dataset_summary"])
def test_no_pairwise_joins(spark, name):
    text = plan(entry.queries()[name](spark, ROOT))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(t):
    carts = plan(orders.cart_contents(t.carts, t.cart_items))
    assert "EqualTo(o_orderstatus,O)" in carts and "o_totalprice" not in carts
    assert "ReadSchema: struct<user_id:bigint,event_type:string,props:string>" in plan(catalog.popularity(t.events))
    reviews = plan(catalog.review_stats(t.reviews))
    assert "l_extendedprice" not in reviews and "o_totalprice" not in reviews
    assert "EqualTo(role,user)" in plan(t.user_turns)


def test_group_limits_run_before_the_shuffle(t):
    assert "WindowGroupLimit" in plan(temporal.latest_purchases(t.events))
    cat = catalog.product_features(t, t.events)
    assert "WindowGroupLimit" in plan(candidates.category_top(cat.where("eligible"), 50))
    hist = history.live_history(history.signals(t.events), DEFAULTS.features.recency)
    users = catalog.users(t)
    assert "WindowGroupLimit" in plan(affinity.category_affinity(hist, catalog.denormalise(t), features.live_examples(users), users, DEFAULTS.features))


def test_history_combines_rows_before_its_shuffle(t):
    text = plan(history.live_history(history.signals(t.events), DEFAULTS.features.recency))
    assert "partial_sum" in text and "partial_count" in text


def test_tables_that_compress_well_are_not_broadcast(spark):
    """A scan is planned by the room its rows take in a hash table, not by the size of its compressed file."""
    bindings.load(spark, ROOT)
    ids = spark.range(600_000).select("id", F.lit(None).cast("timestamp").alias("cutoff"))
    splits, other = stage(ids, "many_ids"), stage(ids, "other_ids")
    assert "BroadcastHashJoin" not in plan(other.join(splits, "id"))
    few = stage(spark.range(200), "few_ids")
    assert "BroadcastHashJoin" in plan(splits.join(few, "id"))
