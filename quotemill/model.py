"""Constants of the quote model: markets, outcomes, thresholds and key columns."""

from __future__ import annotations

from dataclasses import dataclass, field

#: What a market of each type must have quoted before it can be evaluated.
REQUIRED_OUTCOMES = {"three_way": ("1", "X", "2"), "totals": ("OVER", "UNDER"), "handicap": ("1", "X", "2")}
PERIODS = ("full_time", "first_half", "second_half", "unknown")
PHASES = ("pre_match", "live")
LIFECYCLES = ("scheduled", "live", "finished", "postponed_or_canceled")
TERMINAL = ("finished", "postponed_or_canceled")

#: The columns that together name a market; the last three may be null.
MARKET = ["market_type", "market_period", "market_phase", "market_line", "market_rules", "market_specifier"]
#: One price series: a market's outcome at one bookmaker.
SERIES = ["event_id", "bookmaker_id", *MARKET, "outcome"]


@dataclass(frozen=True)
class Market:
    type: str
    period: str = "full_time"
    phase: str = "pre_match"
    line: str | None = None


DEFAULT_MARKET = Market("three_way")
LIVE_MARKET = Market("three_way", phase="live")
TOTALS_2_5_MARKET = Market("totals", line="2.5")
HANDICAP_MINUS_1_MARKET = Market("handicap", line="-1")


@dataclass(frozen=True)
class Freshness:
    """Seconds. Ages outside [-skew, max_age] are stale; a wider spread of what is left
    makes a market incoherent."""

    max_age: int = 60 * 60
    max_spread: int = 30 * 60
    skew: int = 10


DEMO_FRESHNESS = Freshness(5 * 60, 5 * 60)


@dataclass(frozen=True)
class Settings:
    """All that a run can be told; passed on explicitly, never read from the environment."""

    freshness: Freshness = field(default_factory=Freshness)
    min_value_gap_percent: float = 15.0
    min_bookmakers: int = 3
    min_surebet_profit_percent: float = 1.0
    movement_percent: float = 10.0
    movement_window_seconds: int = 24 * 3600
    lag_seconds: int = 120
    signal_ttl_hours: int = 3
    stale_run_minutes: int = 60
    start_tolerance_minutes: int = 30
    fuzzy_threshold: float = 85.0
    fuzzy_margin: float = 5.0
    raw_payload_days: int = 14
    source_payload_days: int = 14
    snapshot_days: int = 90
    movement_days: int = 180
    history_days: int = 180
    health_window_hours: int = 24
    health_max_staleness_hours: int = 24
    poll_seconds: int = 300
    burst_seconds: int = 1800
    burst_start_hour: int | None = None
    burst_end_hour: int | None = None
    source_interval_hours: dict = field(default_factory=dict)
