"""Popularity ranks without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.scan import running_totals
from shelfwise.sources.stage import stage

def popularity_rank(products: DataFrame, group: list[str]) -> DataFrame:
    """Total rank by purchases desc, cart adds desc, id asc, within `group` (empty: the whole catalog), plus the group's size."""
    order = [F.col("purchase_count").desc(), F.col("cart_add_count").desc(), F.col("product_id")]
    ranked = running_totals(products, group, order, out="rank")
    if not group:
        return ranked.withColumn("group_size", products.agg(F.count(F.lit(1)).alias("n")).scalar())
    # Staged, so that Spark can split the join of a large group.
    sizes = stage(products.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size")), "group_sizes")
    return ranked.join(sizes, group)


def rank_score(rank: Column, size: Column) -> Column:
    """Rank 1 scores 1, the last rank 0; a single item scores 1."""
    return F.when(size <= 1, F.lit(1.0)).otherwise(1.0 - (rank - 1) / (size - 1))
