"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000


def hot_keys(facts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least `hot_rows` rows, and into how many parts of about that size each one is cut. There are
    never more than rows / hot_rows of them."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    counted = facts.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows)
    return counted.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))


def salted_join(facts: DataFrame, dims: DataFrame, keys: list[str], condition: Column | None = None,
                how: str = "inner", hot_rows: int = HOT_ROWS, spread: list[str] | None = None) -> DataFrame:
    """Join `facts` to `dims` on `keys` (plus `condition`). Rows of a hot key are spread over sub-keys of about
    `hot_rows` rows and only its own dim rows are repeated; all other keys join as usual. `spread` names the fact
    columns that pick the sub-key, so that a recomputed task picks the same one."""
    if condition is not None and how != "inner":
        raise ValueError("an extra condition is only supported for inner joins")
    hot = F.broadcast(hot_keys(facts, keys, hot_rows))  # bounded by rows / hot_rows
    parts = F.coalesce("_parts", F.lit(1))
    salt = F.pmod(F.xxhash64(*(spread or facts.columns)), parts).cast("int")
    left = facts.join(hot, keys, "left").withColumn("_salt", salt).drop("_parts")
    right = dims.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    joined = left.join(right, [*keys, "_salt"], how)
    if condition is not None:
        joined = joined.where(condition)
    return joined.drop("_salt")
