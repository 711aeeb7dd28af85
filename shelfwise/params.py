"""Weights and thresholds of the recommendation jobs, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

# Signal names, in the order used for blending.
SIGNALS = ("click", "purchase", "cart", "search", "chatbot")

# Log action type -> signal name.
ACTION_SIGNAL = {
    "CLICK": "click",
    "PURCHASE": "purchase",
    "ADD_TO_CART": "cart",
    "SEARCH": "search",
    "CHATBOT": "chatbot",
}

# Price tiers from cheap to expensive.
PRICE_TIERS = ("budget", "mid", "premium")


@dataclass(frozen=True)
class Recency:
    enabled: bool = True
    half_life_days: float = 21.0

    def __post_init__(self):
        if self.half_life_days <= 0:
            raise ValueError(f"half_life_days must be positive, got {self.half_life_days!r}")


@dataclass(frozen=True)
class FeatureParams:
    click_weight: float = 0.1
    purchase_weight: float = 0.45
    cart_weight: float = 0.25
    search_weight: float = 0.15
    chatbot_weight: float = 0.15
    preferred_category_weight: float = 0.5
    max_top_categories: int = 5
    max_top_brands: int = 5
    recency: Recency = field(default_factory=Recency)

    def weight(self, signal: str) -> float:
        return getattr(self, f"{signal}_weight")


@dataclass(frozen=True)
class RetrievalParams:
    candidate_pool_multiplier: int = 5
    min_candidate_pool: int = 50
    probed_cells: int = 16  # of the approximate search, for each query
    search_cells: int = 4_096  # of the bounded search, at most; their centres are sent to every task
    item_block_rows: int = 16_384  # rows of one in-task item matrix
    query_chunk_rows: int = 8_192  # queries multiplied against it at a time


@dataclass(frozen=True)
class ColdStart:
    strong_history_min_signals: int = 5
    sparse_history_min_signals: int = 1
    blend_personalized: float = 0.6
    blend_preferred_category: float = 0.2
    blend_popularity: float = 0.2
    no_history_fallback_order: tuple[str, ...] = ("preferred_category", "category_popularity", "global_popularity")


@dataclass(frozen=True)
class EligibilityParams:
    require_active: bool = True
    require_in_stock: bool = True


@dataclass(frozen=True)
class Reranking:
    diversity_strength: float = 0.5
    category_repetition_penalty: float = 0.15
    brand_repetition_penalty: float = 0.08


@dataclass(frozen=True)
class RankingParams:
    hidden_units: tuple[int, ...] = (128, 64)
    negatives_per_positive: int = 4
    max_iter: int = 40
    random_seed: int = 42


@dataclass(frozen=True)
class Params:
    features: FeatureParams = field(default_factory=FeatureParams)
    retrieval: RetrievalParams = field(default_factory=RetrievalParams)
    cold_start: ColdStart = field(default_factory=ColdStart)
    eligibility: EligibilityParams = field(default_factory=EligibilityParams)
    reranking: Reranking = field(default_factory=Reranking)
    ranking: RankingParams = field(default_factory=RankingParams)
    min_distinct_products_for_holdout: int = 3
    split_seed: int = 42
    temperature: float = 0.05
    top_n: int = 10
    k_values: tuple[int, ...] = (5, 10, 20)


DEFAULTS = Params()
