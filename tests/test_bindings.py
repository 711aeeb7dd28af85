"""The second binding, the gate before serving, and checks that read each table once."""

import os
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import quality
from shelfwise.plans import serve
from shelfwise.plans.features import Catalog
from shelfwise.params import DEFAULTS
from shelfwise.registry import quality_queries
from shelfwise.sources import bindings, mapped, snapshots
from shelfwise.sources.stage import stage_root
from tests.test_serving import feats, store, unit, vec_df

ROOT = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


# --- gate -------------------------------------------------------------------------------------------
def vectors(spark, more=()):
    good = vec_df(spark, unit(14, 4, 7), "product_id", 1).withColumnRenamed("vector", "embedding")
    return good.unionByName(spark.createDataFrame(list(more), good.schema)) if more else good


USERS = [(1, 1, 9, "cat1", "cat1", [1.0, 0.0, 0.0, 0.0]), (2, 2, 0, None, None, None)]


def recommend(spark, users=USERS, more=(), **kw):
    return serve.recommend(feats(spark, users), Catalog(store(spark), None, None, None), vectors(spark, more), DEFAULTS, 5, **kw)


@pytest.mark.parametrize("row,what", [((20, [1.0, 0.0]), "wrong_dim"), ((20, None), "empty"), ((20, []), "empty"), ((20, [1.0, float("nan"), 0.0, 0.0]), "not_finite"),
                                      ((20, [1.0, float("inf"), 0.0, 0.0]), "not_finite"), ((3, [1.0, 0.0, 0.0, 0.0]), "duplicate_ids")])
def test_serving_refuses_unfit_vectors(spark, row, what):
    with pytest.raises(quality.UnfitTable, match=what):
        recommend(spark, more=[row])


@pytest.mark.parametrize("user,what", [((1, 3, 9, None, None, None), "1 ids missing or repeated"), ((None, 3, 9, None, None, None), "1 ids"), ((3, 3, 9, None, None, [1.0, 0.0]), "1 broken"),
                                       ((3, 3, 9, None, None, [1.0, 0.0, 0.0, float("nan")]), "1 broken")])
def test_serving_refuses_unfit_user_rows(spark, user, what):
    with pytest.raises(quality.UnfitTable, match=what):
        recommend(spark, users=[*USERS, user])


def test_serving_refuses_another_length_than_declared(spark):
    assert recommend(spark, dim=4).items.count() == 10
    with pytest.raises(quality.UnfitTable, match="wrong_dim"):
        recommend(spark, dim=5)


def test_equal_ids_are_asked_for(spark):
    products = store(spark)
    quality.require_vectors(vectors(spark), products, 4, same_ids=True)
    with pytest.raises(quality.UnfitTable, match="1 rows ids_not_in_catalog"):
        quality.require_vectors(vectors(spark, [(20, [1.0, 0.0, 0.0, 0.0])]), products, 4, same_ids=True)
    with pytest.raises(quality.UnfitTable, match="1 rows catalog_without_vector"):
        quality.require_vectors(vectors(spark).where("product_id > 1"), products, 4, same_ids=True)
    quality.require_vectors(vectors(spark).limit(0), products, 4)


# --- groups of users --------------------------------------------------------------------------------
def test_one_group_of_most_users_is_split(spark):
    members = spark.range(4000).select(F.col("id").alias("example_id"), F.when(F.col("id") < 3900, "a").otherwise("b").alias("group_id"))
    lists = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "group_id string, rank int, product_id int")
    got = serve._to_members(members, lists)
    assert got.count() == 3900 * 2 + 100 and rows(got) == rows(members.join(lists, "group_id").select(*got.columns))


# --- one-pass checks --------------------------------------------------------------------------------
class Tiny:
    """Tables in memory, with the members that the foreign keys need."""

    def __init__(self, spark, **tables):
        self.spark = spark
        for name, columns in mapped.CANONICAL.items():
            setattr(self, name, spark.createDataFrame(tables.get(name, []), ", ".join(f"{c} {k}" for c, k in columns.items())))


def test_foreign_keys_by_hand(spark):
    t = Tiny(spark, categories=[(1, "a", None), (2, "b", 9)], users=[(1, 1, None), (2, None, None), (3, 7, None)],
             orders=[(1, 1, "O", None), (2, 8, "F", None), (3, 8, "F", None), (4, None, "F", None)], carts=[(1, 1)],
             cart_items=[(1, 5, 1.0), (2, 5, 1.0), (2, 5, 1.0)], events=[(1, 6, 5, "CHATBOT", None), (2, 1, None, "CLICK", None), (3, 6, None, "SEARCH", None)])
    got = {r["check"]: (r.dangling_values, r.dangling_rows) for r in quality.foreign_key_report(t).collect()}
    wrong = {"category.parent_id": (1, 1), "user.preferred_category_id": (1, 1), "order.user_id": (1, 2), "cart_item.cart_id": (1, 2), "cart_item.product_id": (1, 3),
             "chatbot.user_id": (1, 1), "chatbot.mentioned_product_id": (1, 1)}
    assert len(got) == 19 and {c: v for c, v in got.items() if v != (0, 0)} == wrong


def test_summary_and_vector_checks_of_empty_tables(spark):
    t = Tiny(spark)
    got = {r.what: r.value for r in quality.dataset_summary(t).collect()}
    assert len(got) == 11 and all(v is None if k.startswith("share") else v == 0 for k, v in got.items())
    assert {r.value for r in quality.embedding_checks(t.embeddings, t.products, 4).collect()} == {0}


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
def test_each_table_is_read_once(spark):
    t = bindings.load(spark, ROOT)

    def scans(df):
        text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return [re.search(r"(\w+)\.parquet\]", part).group(1) for part in re.findall(r"Location: [^\n]*", text)]

    keys = scans(quality.foreign_key_report(t))
    # child tables: the log, the searches made from it; two kinds of lines, the reviews made from lines
    assert keys.count("events") == 2 and keys.count("lineitem") == 3 and len(keys) < 25, keys
    summary = scans(quality.dataset_summary(t))
    assert summary.count("events") == 1 and summary.count("customer") == 1
    checks = scans(quality.embedding_checks(t.embeddings, t.products, 64))
    assert sorted(checks) == ["embeddings", "part"]


# --- second binding ---------------------------------------------------------------------------------
def fresh(spark, name):
    import uuid
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
def test_both_bindings_give_the_same_tables(spark):
    t = bindings.load(spark, ROOT)
    shop = quality_queries.as_shop(t, fresh(spark, "shop"))
    for name in quality_queries.SHOP:
        ours = getattr(t, name).select(*[F.col(c).cast(k).alias(c) for c, k in mapped.CANONICAL[name].items()])
        theirs = getattr(shop, name)
        if name == "order_items":  # a division written as text and read back
            ours, theirs = ours.drop("unit_price"), theirs.drop("unit_price")
        assert rows(ours) == rows(theirs), name
    with pytest.raises(mapped.UnboundTable, match="tags"):
        shop.tags


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
def test_a_snapshot_under_canonical_names(spark):
    t, path = bindings.load(spark, ROOT), fresh(spark, "same")
    names = ("tags", "product_tags", "embeddings", "chatbot", "searches")
    snapshots.save({n: getattr(t, n) for n in names}, path)
    back = mapped.load(spark, path, mapped.same_names(names))
    assert all(rows(getattr(t, n).select(*mapped.CANONICAL[n])) == rows(getattr(back, n)) for n in names)
    assert isinstance(mapped.load(spark, ROOT), bindings.Tables)


def test_mapping_is_checked(spark):
    with pytest.raises(ValueError, match="orders.*colour"):
        mapped.MappedTables(spark, "/tmp", {"orders": mapped.Stored("o", "id bigint", {"colour": "id"})})
    with pytest.raises(ValueError, match="shoes"):
        mapped.MappedTables(spark, "/tmp", {"shoes": mapped.Stored("o", "id bigint")})


def test_only_mapped_columns_are_read_and_bad_values_fail(spark):
    path = fresh(spark, "bad")
    spark.createDataFrame([("1", "x", "unused"), (None, None, None)], "id string, name string, other string").write.json(f"{path}/words")
    t = mapped.load(spark, path, {"tags": mapped.Stored("words", "id string, name string, other string", {"tag_id": "id"})})
    assert rows(t.tags) == ["Row(tag_id=1, name='x')", "Row(tag_id=None, name=None)"]
    assert "other" not in t.tags._jdf.queryExecution().executedPlan().toString()
    wrong = mapped.load(spark, path, {"tags": mapped.Stored("words", "name string", {"tag_id": "name"})})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        wrong.tags.collect()
