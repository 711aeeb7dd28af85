"""Canonical tables over the benchmark parquet files.

Every downstream job depends only on the column names defined here; binding another store means
writing another `load`. All members are lazy DataFrames with explicit column lists, so column
pruning and filters reach the parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import text as text_fn
from shelfwise.sources.stage import estimate_in_memory

# Category id and parent id per product type, and the two parent categories.
CATEGORY_IDS = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
CATEGORY_PARENTS = {"ECONOMY": 101, "LARGE": 102, "MEDIUM": 102, "PROMO": 101, "SMALL": 102}
PARENT_NAMES = {101: "VALUE", 102: "SIZED"}

# Event type -> action type, market segment -> preferred category.
ACTION_BY_EVENT = {"view": "CLICK", "click": "ADD_TO_CART", "purchase": "PURCHASE", "signup": "SEARCH", "error": "CHATBOT"}
CATEGORY_BY_SEGMENT = {"BUILDING": "STANDARD", "AUTOMOBILE": "LARGE", "MACHINERY": "MEDIUM", "HOUSEHOLD": "SMALL", "FURNITURE": "ECONOMY"}

EMBEDDING_DIM = 64
COUNTED_ORDER_STATUSES = ("F", "P")


def _mapped(column, mapping: dict):
    expr = F.when(F.lit(False), F.lit(next(iter(mapping.values()))))
    for key, value in mapping.items():
        expr = expr.when(column == key, F.lit(value))
    return expr


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    root: str

    def scan(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # --- catalog ---------------------------------------------------------------------------
    @cached_property
    def categories(self) -> DataFrame:
        """Product types and the parent categories in use, from one scan."""
        kind = F.col("p_type")
        parent = _mapped(kind, CATEGORY_PARENTS).cast("bigint")
        leaf = F.struct(_mapped(kind, CATEGORY_IDS).cast("bigint").alias("category_id"), kind.alias("name"), parent.alias("parent_id"))
        above = F.when(parent.isNotNull(), F.struct(parent.alias("category_id"), _mapped(parent, PARENT_NAMES).alias("name"), F.lit(None).cast("bigint").alias("parent_id")))
        types = self.scan("part").select("p_type").distinct()
        return types.select(F.explode(F.array_compact(F.array(leaf, above))).alias("c")).select("c.*").distinct()

    @cached_property
    def products(self) -> DataFrame:
        """Stored product rows, before any join (16 columns of the store map to 12 here)."""
        key, price, size = F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size")
        return self.scan("part").select(
            key.alias("product_id"),
            _mapped(F.col("p_type"), CATEGORY_IDS).cast("bigint").alias("category_id"),
            text_fn.slug(F.concat_ws(" ", F.col("p_name"), key.cast("string"))).alias("slug"),
            F.col("p_name").alias("name"),
            F.when(size % 4 == 0, F.concat(F.lit("size "), size.cast("string"))).alias("description"),
            F.col("p_brand").alias("brand"),
            price.alias("price"),
            F.when(key % 3 == 0, F.round(price * 0.8, 2)).when(key % 11 == 1, F.round(price * 1.1, 2)).alias("sale_price"),
            F.when(key % 3 == 0, F.lit(20.0)).when(key % 11 == 1, F.lit(5.0)).alias("discount_percentage"),
            (key % 8).cast("int").alias("stock_quantity"),
            F.when(size % 5 == 0, F.concat(F.lit("grade "), F.col("p_brand"))).alias("ingredients"),
            (key % 17 != 0).cast("int").alias("is_active"),
        )

    @cached_property
    def product_tags(self) -> DataFrame:
        words = self.scan("part").select(
            F.col("p_partkey").alias("product_id"),
            F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"),
        )
        return words.select("product_id", tag_id(F.col("word")).alias("tag_id"))

    @cached_property
    def tags(self) -> DataFrame:
        words = self.scan("part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
        return words.select(tag_id(F.col("name")).alias("tag_id"), "name")

    # --- users -----------------------------------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        by_segment = {seg: CATEGORY_IDS[name] for seg, name in CATEGORY_BY_SEGMENT.items()}
        return self.scan("customer").select(
            key.alias("user_id"),
            F.when(key % 20 == 0, F.lit(None))
            .when(key % 97 == 5, F.lit(999))
            .otherwise(_mapped(F.col("c_mktsegment"), by_segment))
            .cast("bigint").alias("preferred_category_id"),
            F.col("c_mktsegment").alias("age_group"),
        )

    # --- interaction log -------------------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        return self.scan("events").select(
            "event_id",
            "user_id",
            F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
            _mapped(F.col("event_type"), ACTION_BY_EVENT).alias("action_type"),
            F.col("ts").alias("action_time"),
        )

    # --- orders, carts, reviews ------------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        return self.scan("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self.scan("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        )

    @cached_property
    def carts(self) -> DataFrame:
        return self.orders.where("status = 'O'").select(F.col("order_id").alias("cart_id"), "user_id")

    @cached_property
    def cart_items(self) -> DataFrame:
        return self.order_items.select(F.col("order_id").alias("cart_id"), "product_id", "quantity")

    @cached_property
    def reviews(self) -> DataFrame:
        lines = self.scan("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            (1 + F.col("l_linenumber") % 5).cast("double").alias("rating"), F.col("l_shipdate").alias("created_at"),
        )
        return lines.join(self.orders.select("order_id", "user_id"), "order_id").select("user_id", "product_id", "rating", "created_at")

    # --- vectors and text ------------------------------------------------------------------
    @cached_property
    def embeddings(self) -> DataFrame:
        return self.scan("embeddings").select(F.col("vec_id").alias("product_id"), "embedding")

    @cached_property
    def searches(self) -> DataFrame:
        """Search log with unresolved queries: every fourth search has text but no product."""
        raw = self.events.where("action_type = 'SEARCH'")
        names = self.products.select("product_id", "name")
        open_text = F.col("event_id") % 4 == 0
        return raw.join(names, "product_id", "left").select(
            "event_id", "user_id",
            F.when(~open_text, F.col("product_id")).alias("matched_product_id"),
            F.when(open_text, F.concat(F.lit("Looking for "), F.initcap("name"))).alias("search_term"),
            "action_time",
        )

    @cached_property
    def chatbot(self) -> DataFrame:
        """One record per user and mentioned product, with the user's summary text: the name of the
        product in the user's latest chatbot event."""
        raw = self.events.where("action_type = 'CHATBOT'")
        last = raw.groupBy("user_id").agg(
            F.max_by("product_id", F.struct("action_time", "event_id")).alias("product_id"))
        summary = last.join(self.products.select("product_id", "name"), "product_id", "left").select(
            "user_id", F.concat(F.lit("Asked about "), F.initcap("name")).alias("summary"))
        return summary

    @cached_property
    def user_turns(self) -> DataFrame:
        return self.scan("conversations").where("role = 'user'").select(
            F.col("conv_id").alias("user_id"), "turn", "text")


def tag_id(word):
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint")


def load(spark: SparkSession, root: str) -> Tables:
    estimate_in_memory(spark)
    return Tables(spark, root.rstrip("/"))
