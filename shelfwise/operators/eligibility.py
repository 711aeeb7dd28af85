"""Named eligibility rules applied to id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.catalog import eligibility_rules
from shelfwise.params import EligibilityParams


def apply_rules(ids: DataFrame, id_col: str, catalog: DataFrame, params: EligibilityParams) -> DataFrame:
    """Adds `reasons` (names of failed rules) and `eligible`. An id missing from the catalog fails every
    rule; with no rules everything passes."""
    rules = eligibility_rules(params)
    facts = catalog.select(F.col("product_id").alias(id_col), "is_active", "stock_quantity")
    checks = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    failed = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    out = ids.join(facts, id_col, "left").withColumn("reasons", failed)
    return out.withColumn("eligible", F.size("reasons") == 0).drop("is_active", "stock_quantity")
