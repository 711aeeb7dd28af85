"""Order lines, carts, and the order and cart states derived from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted_purchases(orders: DataFrame, items: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Order lines of orders whose status counts as a purchase."""
    counted = orders.where(F.col("status").isin(list(statuses))).select("order_id", "user_id", "status", "created_at")
    return items.join(counted, "order_id").select("user_id", "product_id", "quantity", "unit_price", "status", "created_at")


def cart_contents(carts: DataFrame, items: DataFrame) -> DataFrame:
    return items.join(carts, "cart_id").select("user_id", "product_id", "quantity")


def order_history(bought: DataFrame) -> DataFrame:
    """Order lines as history rows, undecayed; quantities weigh affinities only, and each distinct unit
    price keeps its own row."""
    return bought.groupBy("user_id", "product_id", "unit_price").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("w"), F.sum("quantity").alias("qty"),
    ).select(F.col("user_id").alias("example_id"), "user_id", F.lit("purchase").alias("signal"), "product_id", "n", "w", "qty", "unit_price")


def derive_orders(events: DataFrame, products: DataFrame) -> DataFrame:
    """One order per (user, calendar day) of purchases."""
    bought = events.where("action_type = 'PURCHASE' AND action_time IS NOT NULL").join(products.select("product_id", "price"), "product_id")
    return bought.groupBy("user_id", F.date_format(F.to_date("action_time"), "yyyy-MM-dd").alias("day")).agg(
        F.min("action_time").alias("created_at"), F.count(F.lit(1)).alias("lines"), F.sum("price").alias("total"))


def current_carts(events: DataFrame) -> DataFrame:
    """Products last added to the cart after any purchase of them."""
    last = events.where("action_type IN ('ADD_TO_CART', 'PURCHASE')").groupBy("user_id", "product_id").agg(
        F.max(F.when(F.col("action_type") == "ADD_TO_CART", F.col("action_time"))).alias("added"),
        F.max(F.when(F.col("action_type") == "PURCHASE", F.col("action_time"))).alias("bought"))
    return last.where("added IS NOT NULL AND (bought IS NULL OR added > bought)").select("user_id", "product_id")


def first_purchases(events: DataFrame) -> DataFrame:
    return events.where("action_type = 'PURCHASE' AND action_time IS NOT NULL").groupBy("user_id", "product_id").agg(
        F.min("action_time").alias("first_time"))
