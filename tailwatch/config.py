"""Parameters of the analysis, all with the values that the published results use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # feature windows, in rows
    drift: tuple = (30, 60)
    vol: tuple = (10, 30)
    momentum: tuple = (5, 20)
    tail_events: int = 28
    std_events: int = 8
    surprise_events: int = 5
    # thresholds of reactions
    flat: float = 0.007
    large: float = 0.05
    extreme: float = 0.08
    # ingest windows, in days
    dedup_days: int = 30
    placeholder_days: int = 60
    validate_days: int = 20
    validate_delta: int = 30
    stale_days: int = 10
    lookback_days: int = 90
    # score
    tail_scale: float = 0.12
    tail_weight: float = 0.85
    entropy_weight: float = 0.15
    elevated: float = 73.0
    high: float = 79.0
    prior: float = 20.0
    # observable quirks of the published results, each of which can be switched off
    regime_term_dead: bool = True
    drift_baseline_full_history: bool = True


CONFIG = Config()

#: The columns that an incremental run takes over from the last full one.
CACHED = (
    "abs_reaction_median abs_reaction_p75 abs_reaction_p75_rolling abs_reaction_p90_rolling reaction_std reaction_entropy "
    "directional_bias surprise_mean_5 surprise_std_5 surprise_streak pre_earnings_drift_z earnings_explosiveness_score earnings_explosiveness_bucket"
).split()
