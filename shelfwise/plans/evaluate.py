"""Evaluation plans: temporal retrieval, the decay experiment, the full recommendation run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import affinity, catalog, history, metrics, retrieval, temporal
from shelfwise.params import DEFAULTS, Params, Recency
from shelfwise.plans import features as feature_plan
from shelfwise.plans import serve
from shelfwise.sources.bindings import EMBEDDING_DIM, Tables
from shelfwise.sources.stage import stage


@dataclass(frozen=True)
class TemporalCases:
    split: DataFrame
    target: DataFrame
    cases: DataFrame      # example_id, user_id, split, cutoff
    relevant: DataFrame   # case_id, item_id

    @property
    def ids(self) -> DataFrame:
        return self.cases.select(F.col("example_id").alias("case_id"), "split")


def temporal_cases(t: Tables, events: DataFrame | None = None) -> TemporalCases:
    log = events if events is not None else t.events
    split = stage(temporal.splits(log, t.users), "splits")
    target = stage(temporal.targets(log, split), "targets")
    return TemporalCases(split, target, temporal.cases(split, target), temporal.relevant(target))


def case_history(t: Tables, cases: DataFrame, recency: Recency, events: DataFrame | None = None) -> DataFrame:
    sig = history.signals(events if events is not None else t.events)
    return stage(history.case_history(sig, cases, recency), "case_history")


def case_features(t: Tables, tc: TemporalCases, cat: feature_plan.Catalog, params: Params = DEFAULTS, recency: Recency | None = None) -> DataFrame:
    hist = case_history(t, tc.cases, recency or params.features.recency)
    return stage(feature_plan.user_features(hist, tc.cases, cat, t.embeddings, params.features), "case_features")


def vector_rankings(t: Tables, hist: DataFrame, eligible_ids: DataFrame, k: int, params: Params = DEFAULTS) -> DataFrame:
    """Top-k eligible items by cosine for each example's vector, no model involved."""
    vec = affinity.user_vectors(affinity.signal_vectors(hist, t.embeddings, params.features, EMBEDDING_DIM), EMBEDDING_DIM)
    queries = stage(vec.select(F.col("example_id").alias("query_id"), "vector"), "case_vectors")
    items = t.embeddings.select(F.col("product_id").alias("item_id"), F.col("embedding").alias("vector"))
    hits = retrieval.nearest_items(queries, items, k, params.retrieval, allowed=eligible_ids)
    return hits.select(F.col("query_id").alias("case_id"), "rank", "item_id", "score")


def eligible_ids(t: Tables, params: Params = DEFAULTS) -> DataFrame:
    p = t.products.withColumn("is_active", F.col("is_active").cast("boolean"))
    return p.where(catalog.eligible(params.eligibility)).select(F.col("product_id").alias("item_id"))


def recency_experiment(t: Tables, params: Params = DEFAULTS, top_n: int = 20, ks: tuple[int, ...] = (5, 10, 20)) -> dict[str, DataFrame]:
    """Rankings of every case with and without decay; the same cases, catalog and scoring in both arms."""
    tc = temporal_cases(t)
    allowed = eligible_ids(t, params)
    arms = {}
    for name, recency in (("decay_off", Recency(enabled=False)), ("decay_on", params.features.recency)):
        arms[name] = stage(vector_rankings(t, case_history(t, tc.cases, recency), allowed, top_n, params), name)
    return {"cases": tc.ids, "relevant": tc.relevant, **arms}


def evaluate_lists(ranked: DataFrame, relevant: DataFrame, cases: DataFrame, ks: tuple[int, ...], by: list[str]) -> DataFrame:
    return metrics.mean_metrics(metrics.case_metrics(ranked, relevant, cases, ks), ks, by)


def evaluate_recommendations(t: Tables, params: Params = DEFAULTS, top_n: int = 10, scorer: Callable[[DataFrame], DataFrame] | None = None,
                             tc: TemporalCases | None = None, cat: feature_plan.Catalog | None = None, feats: DataFrame | None = None):
    """The full serving plan run for every case; returns (cases, relevant, recommendations)."""
    tc = tc or temporal_cases(t)
    cat = cat or feature_plan.build_catalog(t, params, popularity=False)
    feats = feats if feats is not None else case_features(t, tc, cat, params)
    rec = serve.recommend(feats, cat, t.embeddings, params, top_n, scorer)
    return tc, cat, rec


def as_ranked(items: DataFrame) -> DataFrame:
    return items.select(F.col("example_id").alias("case_id"), "rank", F.col("product_id").alias("item_id"), "score")
