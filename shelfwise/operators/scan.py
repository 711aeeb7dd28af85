"""Running totals, numbering and exact quantiles over a total order, without one task that sees all of it.

Rows are cut into ranges of their order, each range is added up by itself, and the sums of the ranges before (one number per
range and group) are added back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.sources.stage import stage


def _joined(left: DataFrame, right: DataFrame, keys: list[str], add: list[str]) -> DataFrame:
    """Left join on `keys`, NULL being equal to NULL."""
    named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *add)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(named, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def running_totals(df: DataFrame, group: list[str], order: list[Column], value: str | None = None, out: str = "upto") -> DataFrame:
    """`df` with `out`: the sum of `value`, or the number of rows, of the rows of its group (none: all rows) up to this one in
    `order`. The order is total: no two rows of a group are equal in it. A group of any size is cut into ranges like
    everything else; NULL is a group. No rows give no rows."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Staged, so that range numbers stay what they are when tasks are repeated.
    dealt = stage(df.repartitionByRange(tasks, *[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id()), "order_ranges")
    amount = F.lit(1) if value is None else F.col(value)
    inside = F.sum(amount).over(W.partitionBy("_range", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = dealt.withColumn("_inside", inside)
    sums = dealt.groupBy("_range", *group).agg(F.sum(amount).alias("_sum"))
    entries = F.collect_list(F.struct("_range", "_sum")).alias("_sums")  # one per range at most
    before = F.aggregate(F.filter("_sums", lambda s: s["_range"] < F.col("_range")), F.lit(0).cast(sums.schema["_sum"].dataType), lambda a, s: a + s["_sum"])
    if group:
        offsets = _joined(sums, sums.groupBy(*group).agg(entries), group, ["_sums"]).select("_range", *group, before.alias("_before"))
        rows = _joined(rows, offsets, ["_range", *group], ["_before"])
    else:
        rows = rows.withColumn("_sums", sums.agg(entries).scalar()).withColumn("_before", before).drop("_sums")
    return rows.withColumn(out, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def quantiles(df: DataFrame, group: list[str], column: str, shares: list[float]) -> DataFrame:
    """(group, p): the quantiles of `column` at each of `shares`, between neighbours by linear interpolation. NULL values are left out; a
    group without values has no row (without `group`: one row of NULLs).

    A value stands at place i when the running count of values first passes i, so each quantile is the least of the values
    whose count does: grouped minima that combine before their shuffle, and no list of values anywhere."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, F.col(column).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    rows = running_totals(counts, group, [F.col("_x")], "_n", "_upto")
    if group:
        # The size of a group, known to each of its rows; staged, so that Spark can split the join of a large group.
        rows = _joined(rows, stage(rows.groupBy(*group).agg(F.sum("_n").alias("_total")), "group_sizes"), group, ["_total"])
    else:
        rows = rows.withColumn("_total", rows.agg(F.sum("_n").alias("n")).scalar())
    place = [(F.col("_total") - 1) * F.lit(share) for share in shares]
    at = [F.min(F.when(F.col("_upto") > edge(p), F.col("_x"))).alias(f"_{name}{i}") for i, p in enumerate(place) for name, edge in (("low", F.floor), ("high", F.ceil))]
    found = rows.groupBy(*group).agg(F.max("_total").alias("_total"), *at)
    values = [F.when(F.floor(p) == F.ceil(p), F.col(f"_low{i}")).otherwise((F.ceil(p) - p) * F.col(f"_low{i}") + (p - F.floor(p)) * F.col(f"_high{i}")) for i, p in enumerate(place)]
    return found.select(*group, F.array(*values).alias("p"))
