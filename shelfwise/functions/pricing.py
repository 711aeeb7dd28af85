"""Price rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_discounted(price: Column, sale_price: Column) -> Column:
    return F.coalesce((sale_price > 0) & (sale_price < price), F.lit(False))


def effective_price(price: Column, sale_price: Column) -> Column:
    return F.when(is_discounted(price, sale_price), sale_price).otherwise(price)


def price_tier(price: Column, lower: Column, upper: Column) -> Column:
    return F.when(price <= lower, "budget").when(price <= upper, "mid").otherwise("premium")


def relative_distance(candidate: Column, typical: Column, epsilon: float = 1e-6) -> Column:
    gap = F.abs(candidate - typical) / F.greatest(typical, F.lit(epsilon))
    return F.when(typical.isNull(), F.lit(0.0)).otherwise(gap)


def normalised(price: Column, max_price: Column) -> Column:
    """min(price / max, 1), or 0 when there is no positive maximum."""
    return F.when(max_price > 0, F.least(price / max_price, F.lit(1.0))).otherwise(F.lit(0.0))
