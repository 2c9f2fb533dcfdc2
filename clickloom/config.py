"""Tunables shared by the operators, with the defaults the results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Event weights, event codes and cohort bounds.
EVENT_WEIGHTS = {"purchase": 4, "cart": 2, "view": 1}
EVENT_CODES = {"view": 1, "cart": 2, "purchase": 3}
COHORTS = (("cold", 3, 10), ("medium", 11, 50), ("warm", 51, None))
UNKNOWN = "unknown"
PAD = 0


@dataclass(frozen=True)
class Config:
    near_dup_seconds: int = 1
    price_floor: float = 1.0
    bot_events_per_day: float = 300.0
    core_k: int = 3
    core_rounds: int | None = None  # a number makes an unfinished k-core an error
    session_min_len: int = 2
    session_max_len: int = 20
    user_max_len: int = 50
    warm_pairs: int = 20
    hard_negatives: int = 3
    neighbour_cap: int | None = None
    drift_threshold: float = 0.1
    drift_top_n: int = 50
    event_weights: dict = field(default_factory=lambda: dict(EVENT_WEIGHTS))
    event_codes: dict = field(default_factory=lambda: dict(EVENT_CODES))
