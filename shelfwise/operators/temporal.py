"""Temporal future-purchase protocol: splits, targets, cases, audits.

The two latest purchases of each user decide everything. They are found with rank() <= 2, which Spark limits
per group before the shuffle, so no task ever holds all purchases of a heavy user, and the fact table is
not joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.operators.catalog import purchases
from shelfwise.operators.skew import salted_join


def timed_purchases(events: DataFrame) -> DataFrame:
    return purchases(events).where("action_time IS NOT NULL")


def latest_purchases(events: DataFrame) -> DataFrame:
    """Purchases at or after the second-to-last purchase time of their user; equal times count as separate
    purchases. `rank` is 1 at the latest time and 2 at the one before (absent when the latest is tied)."""
    by_time = W.partitionBy("user_id").orderBy(F.col("action_time").desc())
    return timed_purchases(events).select("user_id", "product_id", "action_time").withColumn("rank", F.rank().over(by_time)).where("rank <= 2")


def splits(events: DataFrame, users: DataFrame) -> DataFrame:
    """Tier, cutoffs and purchase counts of every user."""
    late = latest_purchases(events).groupBy("user_id").agg(
        F.max("action_time").alias("t1"), F.min("action_time").alias("t2"),
        F.count(F.lit(1)).alias("late_rows"), F.count(F.when(F.col("rank") == 1, 1)).alias("last_rows"))
    activity = events.groupBy("user_id").agg(F.count(F.when((F.col("action_type") == "PURCHASE") & F.col("action_time").isNotNull(), 1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    tier = (F.when(n >= 3, "FULL").when(n == 2, "VAL_ONLY").when(n == 1, "INSUFFICIENT_DEPTH")
            .when(F.col("n").isNotNull(), "ENGAGEMENT_NO_PURCHASE").otherwise("NO_HISTORY"))
    train = F.when(n >= 3, n - F.col("late_rows")).when(n == 2, n - F.col("last_rows")).otherwise(n)
    return users.select("user_id").join(activity, "user_id", "left").join(late, "user_id", "left").select(
        "user_id", tier.alias("tier"),
        F.when(n >= 3, F.col("t2")).when(n == 2, F.col("t1")).alias("val_cutoff"),
        F.when(n >= 3, F.col("t1")).alias("test_cutoff"),
        train.cast("bigint").alias("train_purchases"), n.cast("bigint").alias("total_purchases"))


def targets(events: DataFrame, split: DataFrame) -> DataFrame:
    """Distinct target products per (user, split): val in [val_cutoff, test_cutoff), test from test_cutoff."""
    late = latest_purchases(events).join(split.where("val_cutoff IS NOT NULL").select("user_id", "val_cutoff", "test_cutoff"), "user_id")
    role = F.when(F.col("action_time") >= F.col("test_cutoff"), "test").when(F.col("action_time") >= F.col("val_cutoff"), "val")
    return late.select("user_id", role.alias("split"), "product_id").where("split IS NOT NULL").distinct()


def window_targets(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Distinct purchased products in [lower, upper) per user; a NULL upper bound is open."""
    rows = salted_join(timed_purchases(events).select("event_id", "user_id", "product_id", "action_time"), bounds, ["user_id"], spread=["event_id"],
                       condition=(F.col("action_time") >= F.col("lower")) & (F.col("upper").isNull() | (F.col("action_time") < F.col("upper"))))
    return rows.select("user_id", "product_id").distinct()


def case_id(user_id, split) -> F.Column:
    return (user_id * 2 + F.when(split == "test", 1).otherwise(0)).cast("bigint")


def cases(split: DataFrame, target: DataFrame) -> DataFrame:
    """Evaluable points: a cutoff and at least one target."""
    points = target.select("user_id", "split").distinct().join(split.select("user_id", "val_cutoff", "test_cutoff"), "user_id")
    return points.select(case_id(F.col("user_id"), F.col("split")).alias("example_id"), "user_id", "split",
                         F.when(F.col("split") == "val", F.col("val_cutoff")).otherwise(F.col("test_cutoff")).alias("cutoff"))


def relevant(target: DataFrame) -> DataFrame:
    return target.select(case_id(F.col("user_id"), F.col("split")).alias("case_id"), F.col("product_id").alias("item_id"))


def cutoffs(split: DataFrame) -> DataFrame:
    """Every cutoff of every user as one row, evaluable or not."""
    both = F.explode(F.array(F.struct(F.lit("val").alias("split"), F.col("val_cutoff").alias("cutoff")),
                             F.struct(F.lit("test").alias("split"), F.col("test_cutoff").alias("cutoff"))))
    return split.select("user_id", both.alias("p")).select("user_id", "p.split", "p.cutoff").where("cutoff IS NOT NULL")


def point_in_time(events: DataFrame, points: DataFrame) -> DataFrame:
    """Events strictly before each point's cutoff."""
    return salted_join(events, points, ["user_id"], condition=F.col("action_time") < F.col("cutoff"), spread=["event_id"])


def audit(history: DataFrame, points: DataFrame, target: DataFrame) -> DataFrame:
    """Violations per point: history rows without a time, or at or after the cutoff. `history` is whatever
    was really used, with (user_id, split) naming its point. An earlier purchase of a target is legal."""
    marked = target.select("user_id", "split", "product_id", F.lit(True).alias("is_target"))
    bad = F.col("action_time").isNull() | (F.col("action_time") >= F.col("cutoff"))
    # no violating row is expected, so the filter runs before anything else touches the rows
    rows = salted_join(history.select("user_id", "split", "product_id", "action_type", "action_time"), points.select("user_id", "split", "cutoff"), ["user_id", "split"], condition=bad)
    rows = rows.join(marked, ["user_id", "split", "product_id"], "left")
    found = rows.groupBy("user_id", "split").agg(
        F.count(F.lit(1)).alias("violations"), F.count(F.when(F.col("action_time").isNull(), 1)).alias("without_time"),
        F.count(F.when(F.col("is_target") & F.col("action_time").isNotNull(), 1)).alias("on_targets"))
    out = points.select("user_id", "split", "cutoff").join(found, ["user_id", "split"], "left")
    return out.select("user_id", "split", "cutoff", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("violations", "without_time", "on_targets")])


def audit_messages(history: DataFrame, points: DataFrame, target: DataFrame) -> DataFrame:
    """One readable line per violation."""
    marked = target.select("user_id", "split", "product_id", F.lit(True).alias("is_target"))
    rows = history.join(points.select("user_id", "split", "cutoff"), ["user_id", "split"]).where(
        F.col("action_time").isNull() | (F.col("action_time") >= F.col("cutoff")))
    rows = rows.join(marked, ["user_id", "split", "product_id"], "left")
    head = F.concat(F.lit("event product_id="), F.col("product_id").cast("string"), F.lit(" action_type="), "action_type")
    text = F.when(F.col("action_time").isNull(), F.concat(head, F.lit(" has no action_time"))).otherwise(
        F.concat(head, F.lit(" action_time="), F.col("action_time").cast("string"), F.lit(" >= cutoff="), F.col("cutoff").cast("string"),
                 F.when(F.col("is_target"), F.lit(" [TARGET PRODUCT]")).otherwise(F.lit(""))))
    return rows.select("user_id", "split", text.alias("violation"))


def purchased_pairs(events: DataFrame) -> DataFrame:
    """Every product a user ever purchases, past or future."""
    return purchases(events).select("user_id", "product_id").distinct()


def repeat_targets(events: DataFrame, split: DataFrame, target: DataFrame) -> DataFrame:
    """Targets their user had already purchased before the cutoff. Only the first purchase time of each
    (user, product) matters, so the log is aggregated before the join."""
    first = timed_purchases(events).groupBy("user_id", "product_id").agg(F.min("action_time").alias("first_time"))
    pts = target.join(cutoffs(split), ["user_id", "split"])
    return pts.join(first, ["user_id", "product_id"]).where("first_time < cutoff").select("user_id", "split", "product_id")


def timeline(events: DataFrame, split: DataFrame) -> DataFrame:
    """Every event labelled against its user's last cutoff: past input, held out, or target."""
    pts = split.select("user_id", F.coalesce("test_cutoff", "val_cutoff").alias("cutoff"))
    rows = events.join(pts, "user_id", "left")
    role = (F.when(F.col("cutoff").isNull() | (F.col("action_time") < F.col("cutoff")), "past")
            .when((F.col("action_type") == "PURCHASE") & (F.col("action_time") >= F.col("cutoff")), "target").otherwise("held_out"))
    return rows.select("event_id", "user_id", "product_id", "action_type", "action_time", "cutoff", role.alias("role"))


def chronological(events: DataFrame, salt_seconds: int = 86_400) -> DataFrame:
    """Position of each event in its user's time order, times missing last. Positions are counted inside
    fixed time cells and shifted by the rows of earlier cells, so a heavy user is spread over many tasks."""
    cell = F.coalesce(F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("action_time")) / salt_seconds),
                      F.lit(1 << 60))
    rows = events.withColumn("cell", cell)
    inside = F.row_number().over(W.partitionBy("user_id", "cell").orderBy(F.col("action_time").asc_nulls_last(), "event_id"))
    sizes = rows.groupBy("user_id", "cell").agg(F.count(F.lit(1)).alias("rows"))
    ahead = F.sum("rows").over(W.partitionBy("user_id").orderBy("cell")) - F.col("rows")
    sizes = sizes.select("user_id", "cell", ahead.alias("ahead"))
    return rows.withColumn("inside", inside).join(sizes, ["user_id", "cell"]).withColumn(
        "position", (F.col("inside") + F.col("ahead")).cast("bigint")).drop("cell", "inside", "ahead")


def split_statistics(events: DataFrame, split: DataFrame, target: DataFrame, repeats: DataFrame) -> DataFrame:
    """Long (statistic, value) rows of the split."""
    def rows(df, key):
        return df.select(key.alias("statistic"), F.col("value").cast("bigint").alias("value"))

    tiers = rows(split.groupBy("tier").agg(F.count(F.lit(1)).alias("value")), F.concat(F.lit("users_"), F.lower("tier")))
    by_split = target.groupBy("split").agg(F.count(F.lit(1)).alias("targets"), F.countDistinct("product_id").alias("distinct_target_products"),
                                           F.countDistinct("user_id").alias("evaluable_users"))
    packed = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("value")) for n in ("targets", "distinct_target_products", "evaluable_users")]))
    by_split = by_split.select("split", packed.alias("s")).select(F.concat_ws("_", "split", "s.n").alias("statistic"), F.col("s.value").cast("bigint").alias("value"))
    rep = rows(repeats.groupBy("split").agg(F.countDistinct("user_id").alias("value")), F.concat_ws("_", "split", F.lit("users_with_repeat_targets")))
    train = rows(split.agg(F.sum("train_purchases").alias("value")), F.lit("train_purchases"))
    log = events.agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("action_type") == "PURCHASE", 1)).alias("purchase_events"))
    log = log.select(F.explode(F.array(F.struct(F.lit("events").alias("statistic"), F.col("events").alias("value")),
                                       F.struct(F.lit("purchase_events").alias("statistic"), F.col("purchase_events").alias("value")))).alias("s")).select("s.*")
    return tiers.unionByName(by_split).unionByName(rep).unionByName(train).unionByName(log)
