"""Dense-vector arithmetic on array columns, kept inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def has_cosine(a: Column, b: Column) -> Column:
    return F.coalesce((norm(a) > 0) & (norm(b) > 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a side is NULL or has no length."""
    return F.when(has_cosine(a, b), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def l2_normalise(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def weighted_sum(vector: str, weight: str, dim: int) -> Column:
    """Aggregate over two named columns: element-wise SUM(weight * vector), as one partial aggregation of
    `dim` sums (no row explosion, combined map-side)."""
    return F.expr("array(" + ", ".join(f"sum({weight} * {vector}[{i}])" for i in range(dim)) + ")")


def scale(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


def checked(df: DataFrame, column: str, dim: int | None = None) -> DataFrame:
    """`df`, whose job fails where a vector has another length than `dim` or a value that is no finite number. NULL passes."""
    good = is_finite(F.col(column)) if dim is None else is_finite(F.col(column)) & (F.size(column) == dim)
    what = "a vector holds a value that is not finite" if dim is None else f"a vector holds a value that is not finite, or does not have {dim} values"
    return df.withColumn(column, F.when(F.col(column).isNull() | good, F.col(column)).otherwise(F.raise_error(F.lit(what)).cast(df.schema[column].dataType)))


def is_finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return ~F.coalesce(bad, F.lit(True))
