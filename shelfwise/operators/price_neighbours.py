"""Price candidates for users: the first price at or above the typical one, and the far end of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 4096


def close_and_far(profiles: DataFrame, products: DataFrame, cells: int = CELLS) -> DataFrame:
    """(user_id, typical_price, close_id, close_price, far_id, far_price). Close: the cheapest product at or above
    the typical price (the dearest one if there is none). Far: the cheapest product for users in the upper half of
    the catalog, else the dearest.

    Distinct typical prices meet distinct product prices in windows over price cells, linear in both; users and
    products are never paired."""
    p = products.groupBy(F.col("effective_price").alias("price")).agg(F.count(F.lit(1)).alias("n"), F.min("product_id").alias("first_id"), F.max("product_id").alias("last_id"))
    ends = p.agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.min_by("first_id", "price").alias("lo_id"), F.max_by("last_id", "price").alias("hi_id"), F.sum("n").alias("total"))
    ends = ends.select(F.struct("lo", "hi", "lo_id", "hi_id", "total").alias("e")).scalar()
    u = profiles.select(F.col("typical_price").alias("price")).distinct()
    rows = p.select("price", "n", "first_id", F.lit(False).alias("asked")).unionByName(
        u.select("price", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("first_id"), F.lit(True).alias("asked"))).withColumn("e", ends)
    width = F.greatest(F.col("e.hi") - F.col("e.lo"), F.lit(1e-9)) / cells
    rows = rows.withColumn("cell", F.least(F.greatest(F.floor((F.col("price") - F.col("e.lo")) / width), F.lit(-1)), F.lit(cells)))
    offer = F.when(~F.col("asked"), F.struct("price", "first_id"))
    ahead = W.partitionBy("cell").orderBy("price").rangeBetween(W.currentRow, W.unboundedFollowing)
    below = W.partitionBy("cell").orderBy("price").rangeBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.withColumn("next_in", F.min(offer).over(ahead)).withColumn("upto_in", F.sum("n").over(below)).withColumn(
        "own_n", F.sum("n").over(W.partitionBy("cell", "price")))
    per_cell = rows.groupBy("cell").agg(F.min(offer).alias("head"), F.sum("n").alias("cell_n"))  # at most cells + 2 rows
    order = W.partitionBy(F.lit(0)).orderBy("cell")
    per_cell = per_cell.select("cell", F.min("head").over(order.rowsBetween(1, W.unboundedFollowing)).alias("next_cell"),
                               (F.sum("cell_n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cell_n")).alias("before"))
    asked = inside.where("asked").join(per_cell, "cell")
    close = F.coalesce("next_in", "next_cell", F.struct(F.col("e.hi").alias("price"), F.col("e.hi_id").alias("first_id")))
    less = F.col("before") + F.col("upto_in") - F.col("own_n")
    upper = less > F.col("e.total") / 2
    found = asked.select(F.col("price").alias("typical_price"), close.alias("c"), F.when(upper, F.col("e.lo_id")).otherwise(F.col("e.hi_id")).alias("far_id"),
                         F.when(upper, F.col("e.lo")).otherwise(F.col("e.hi")).alias("far_price"))
    return profiles.select("user_id", "typical_price").join(found, "typical_price").select(
        "user_id", "typical_price", F.col("c.first_id").alias("close_id"), F.col("c.price").alias("close_price"), "far_id", "far_price")
