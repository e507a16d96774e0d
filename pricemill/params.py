"""Business parameters.

Fixed values: they decide which rows are flagged, priced, routed or rejected.
Shares are integer basis points, so that every rule can be tested in whole cents.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    # guardrails
    min_margin_bp: int = 1500
    max_change_bp: int = 2500
    low_stock_units: int = 10

    # market analysis
    flag_gap_bp: int = 300
    trend_class_limit: float = 0.01

    # joint pricing
    small_change_bp: int = 500
    small_change_confidence: float = 0.92
    large_change_confidence: float = 0.85
    discount_budget_bp: int = 1000
    grid_points: int = 21
    default_elasticity: float = -1.5
    objective: str = "profit"

    # suggestions
    fallback_confidence: float = 0.5
    min_suggested_price: float = 0.01

    # approval
    auto_confidence: float = 0.90
    answer_seconds: int = 300

    # listing matching
    match_threshold: float = 80.0
    model_bonus: float = 10.0
    model_penalty: float = 15.0
    shortlist: int = 5

    # elasticity fit
    min_observations: int = 8
    min_gap_std: float = 1e-4
    min_mean_units: float = 1.0

    # run metrics and call budget
    trend_noise: float = 0.01
    max_calls: int = 100
    max_cost_usd: float = 1.0
    summary_items: int = 20

    # reporting
    trailing_days: int = 7
    price_moved: float = 0.005


DEFAULT_POLICY = Policy()
