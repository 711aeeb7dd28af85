"""Signals and per-example history.

An *example* is one feature build: a user at a point in time. Everything downstream (affinities, vectors,
price profile, counts) reads the history table, one row per (example, signal, product):

    example_id, user_id, signal, product_id, n, w, last_time

`n` counts events and `w` sums their decay factors. Both are partial aggregates, so events are combined
before the shuffle and a heavy user costs at most one row per (signal, product).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.recency import recency_factor
from shelfwise.operators.skew import salted_join
from shelfwise.params import ACTION_SIGNAL, Recency


def signal_of(action_type: Column) -> Column:
    mapped = F.lit(None).cast("string")
    for action, signal in ACTION_SIGNAL.items():
        mapped = F.when(action_type == action, signal).otherwise(mapped)
    return mapped


def signals(events: DataFrame, strict: bool = True) -> DataFrame:
    """The log as one long table of five signals; quantity is 1, search is always resolved. An unknown
    action type fails the job (strict) or is dropped."""
    mapped = signal_of(F.col("action_type"))
    if strict:
        mapped = F.coalesce(mapped, F.raise_error(F.concat(F.lit("unknown action type "), F.coalesce("action_type", F.lit("NULL")))).cast("string"))
    return events.select("event_id", "user_id", "product_id", mapped.alias("signal"), F.col("action_time").alias("ts")).where("signal IS NOT NULL")


def reject_unknown_actions(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce(F.col("action_type").isin(list(ACTION_SIGNAL)), F.lit(False)))


def before(events: DataFrame, cutoff: Column, time: str = "action_time") -> DataFrame:
    """Strictly earlier rows; rows without a time are never known to be earlier."""
    return events.where(F.col(time) < cutoff)


def _aggregate(rows: DataFrame, reference: Column | None, recency: Recency) -> DataFrame:
    raw = rows.groupBy("example_id", "user_id", "signal", "product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(recency_factor(F.col("ts"), reference, recency)).alias("w"),
        F.max("ts").alias("last_time"),
        F.max("ref").alias("ref"),
    )
    return raw


def _chatbot_time(hist: DataFrame, recency: Recency) -> DataFrame:
    """All chatbot rows of an example share the time of its latest mention."""
    last = hist.where("signal = 'chatbot'").groupBy("example_id").agg(F.max("last_time").alias("chat_time"))
    shared = F.col("n") * recency_factor(F.col("chat_time"), F.col("ref"), recency)
    return hist.join(last, "example_id", "left").withColumn(
        "w", F.when(F.col("signal") == "chatbot", shared).otherwise(F.col("w"))).drop("chat_time")


def live_history(sig: DataFrame, recency: Recency, as_of: Column | None = None) -> DataFrame:
    """One example per user over the whole log, aged against `as_of` (None: no decay)."""
    reference = as_of if as_of is not None else F.lit(None).cast("timestamp_ntz")
    rows = sig.withColumn("example_id", F.col("user_id")).withColumn("ref", reference)
    return _chatbot_time(_aggregate(rows, F.col("ref"), recency), recency).drop("ref")


def case_history(sig: DataFrame, cases: DataFrame, recency: Recency) -> DataFrame:
    """Point-in-time history: for each case (example_id, user_id, cutoff) its user's events strictly before
    the cutoff, aged against the cutoff. Cases per user are few; heavy users are salted."""
    rows = salted_join(sig, cases.select("example_id", "user_id", "cutoff"), ["user_id"],
                       condition=F.col("ts") < F.col("cutoff"), spread=["event_id"])
    rows = rows.withColumnRenamed("cutoff", "ref")
    return _chatbot_time(_aggregate(rows, F.col("ref"), recency), recency).drop("ref")


def engagement_counts(hist: DataFrame, examples: DataFrame) -> DataFrame:
    """Undecayed counts per example; chatbot counts once. Examples without history get zeros."""
    def total(signal):
        return F.coalesce(F.sum(F.when(F.col("signal") == signal, F.col("n"))), F.lit(0)).cast("bigint")

    zero = F.lit(0).cast("bigint")
    agg = hist.groupBy("example_id").agg(
        total("click").alias("click_count"), total("purchase").alias("purchase_count"),
        F.count(F.when(F.col("signal") == "purchase", 1)).alias("distinct_products_purchased"),
        total("cart").alias("cart_item_count"), total("search").alias("search_count"),
        (total("chatbot") > 0).alias("has_chatbot_context"),
    )
    names = ["click_count", "purchase_count", "distinct_products_purchased", "cart_item_count", "search_count"]
    out = examples.select("example_id", "user_id").join(agg, "example_id", "left")
    out = out.select("example_id", "user_id", *[F.coalesce(n, zero).alias(n) for n in names],
                     F.coalesce("has_chatbot_context", F.lit(False)).alias("has_chatbot_context"))
    total_events = F.col("click_count") + F.col("purchase_count") + F.col("cart_item_count") + F.col("search_count")
    return out.withColumn("total_engagement_events", total_events + F.col("has_chatbot_context").cast("bigint"))


def chatbot_context(events: DataFrame) -> DataFrame:
    """Mentioned products and latest time per user, as long rows (user, product, mentions, latest time)."""
    per = events.where("action_type = 'CHATBOT'").groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("mentions"), F.max("action_time").alias("t"))
    last = per.groupBy("user_id").agg(F.max("t").alias("chat_time"))
    return per.join(last, "user_id").select("user_id", "product_id", "mentions", "chat_time")
