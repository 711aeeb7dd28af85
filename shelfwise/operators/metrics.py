"""Ranking quality: precision, recall, hit rate, NDCG, reciprocal rank, and list quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.scan import running_totals


def _ideal(relevant: Column, k: int) -> Column:
    top = F.least(relevant, F.lit(k)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), top), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))


def case_metrics(ranked: DataFrame, relevant: DataFrame, cases: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row per case with columns precision_k, recall_k, hit_k, ndcg_k and rr. `ranked` has (case_id, rank,
    item_id) with rank from 1; cases without list or without relevant items score 0. Precision, recall and
    hits count an item once, NDCG counts every position."""
    rel = relevant.select("case_id", "item_id").distinct()
    hits = ranked.select("case_id", "rank", "item_id").join(rel, ["case_id", "item_id"])
    gains = [F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}") for k in ks]
    per_item = hits.groupBy("case_id", "item_id").agg(F.min("rank").alias("first"), *gains)
    per_case = per_item.groupBy("case_id").agg(
        F.min("first").alias("first"), *[F.count(F.when(F.col("first") <= k, 1)).alias(f"hits_{k}") for k in ks], *[F.sum(f"dcg_{k}").alias(f"dcg_{k}") for k in ks])
    size = rel.groupBy("case_id").agg(F.count(F.lit(1)).alias("relevant"))
    out = cases.join(size, "case_id", "left").join(per_case, "case_id", "left")
    n, zero = F.col("relevant"), F.lit(0.0)
    cols = [F.coalesce(1 / F.col("first"), zero).alias("rr")]
    for k in ks:
        h = F.coalesce(F.col(f"hits_{k}"), F.lit(0))
        cols += [
            (h / k).alias(f"precision_{k}"),
            F.coalesce(h / n, zero).alias(f"recall_{k}"),
            F.when(h > 0, F.lit(1.0)).otherwise(zero).alias(f"hit_{k}"),
            F.coalesce(F.col(f"dcg_{k}") / _ideal(n, k), zero).alias(f"ndcg_{k}"),
        ]
    return out.select(*cases.columns, *cols)


def mean_metrics(per_case: DataFrame, ks: tuple[int, ...], by: list[str] | None = None) -> DataFrame:
    """Means over cases as long (metric, k, value) rows; k is 0 for the reciprocal rank."""
    by = by or []
    names = [(m, k, f"{m}_{k}") for k in ks for m in ("precision", "recall", "hit", "ndcg")] + [("mrr", 0, "rr")]
    agg = per_case.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *[F.avg(c).alias(c) for _, _, c in names])
    packed = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).cast("bigint").alias("k"), F.col(c).alias("value")) for m, k, c in names]))
    return agg.where("cases > 0").select(*by, "cases", packed.alias("s")).select(*by, "cases", "s.*")


def list_quality(ranked: DataFrame, cases: DataFrame, catalog: DataFrame, top_n: int) -> DataFrame:
    """Per case: returned rows, distinct categories, duplicate flag and fill rate of the first `top_n`."""
    top = ranked.where(F.col("rank") <= top_n).join(catalog.select(F.col("product_id").alias("item_id"), "category_name"), "item_id", "left")
    per_item = top.groupBy("case_id", "item_id").agg(F.count(F.lit(1)).alias("times"), F.first("category_name").alias("category_name"))
    per = per_item.groupBy("case_id").agg(F.sum("times").alias("returned"), F.count(F.lit(1)).alias("items"), F.countDistinct("category_name").alias("categories"))
    out = cases.join(per, "case_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(*cases.columns, F.coalesce("returned", zero).alias("returned"), F.coalesce("categories", zero).alias("distinct_categories"),
                      F.when(F.coalesce(F.col("returned") > F.col("items"), F.lit(False)), 1.0).otherwise(0.0).alias("duplicate"),
                      (F.coalesce("returned", zero) / top_n).alias("fill_rate"))


def mean_quality(quality: DataFrame, ranked: DataFrame, catalog_size: Column, top_n: int) -> DataFrame:
    """One row of list-quality means plus catalog coverage."""
    seen = ranked.where(F.col("rank") <= top_n).select("item_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    agg = quality.agg(F.avg("distinct_categories").alias("mean_distinct_categories"), F.avg("duplicate").alias("duplicate_rate"), F.avg("fill_rate").alias("fill_rate"))
    return agg.withColumn("coverage", F.when(catalog_size > 0, seen / catalog_size).otherwise(F.lit(0.0)))


def paired_hits(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """How often only one of two arms hits within k, both, or neither."""
    j = a.select("case_id", (F.col(f"hit_{k}") > 0).alias("hit_a")).join(b.select("case_id", (F.col(f"hit_{k}") > 0).alias("hit_b")), "case_id")
    return j.groupBy("hit_a", "hit_b").agg(F.count(F.lit(1)).alias("cases"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row (auc, positives, negatives): the share of pairs of a positive and a negative row in which the positive scores
    higher, ties counting half; NULL without either kind. From ranks: a running count over distinct scores gives every score its mean rank."""
    counts = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col(label) > 0).cast("bigint")).alias("_pos"))
    ranked = running_totals(counts, [], [F.col("_s")], "_n", "_upto")
    sums = ranked.agg(F.sum(F.col("_pos") * (F.col("_upto") - (F.col("_n") - 1) / 2)).alias("r"), F.coalesce(F.sum("_pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum(F.col("_n") - F.col("_pos")), F.lit(0)).alias("negatives"))
    p, n = F.col("positives"), F.col("negatives")
    return sums.select(F.when((p > 0) & (n > 0), (F.col("r") - p * (p + 1) / 2) / (p.cast("double") * n)).alias("auc"), "positives", "negatives")
