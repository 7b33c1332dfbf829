"""Rule versions, thresholds and other fixed settings.

Money is carried as BIGINT paise (`*_p` columns), time as BIGINT microseconds (`t_us`), so sums and window bounds
are exact and do not depend on the order in which partial aggregates are merged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SEC = 1_000_000
HOUR = 3_600 * SEC
DAY = 86_400 * SEC
PAISE = 100

# Detectors in the order in which one payment is checked, and which of them count as primary.
DETECTORS = ("inflow_new_payers", "structuring", "fan_in_new_payers", "pass_through", "hop_from_flagged", "model_only")
PRIMARY = ("inflow_new_payers", "structuring", "fan_in_new_payers", "pass_through")
SEVERITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}
LEVEL_ACTION = {0: "alert_only", 1: "delay_settlement", 2: "hold_outbound", 3: "full_hold"}
LEVEL_HOURS = {1: 1, 2: 24, 3: 72}
#: Alerts that still count.
LIVE = "status NOT IN ('cleared', 'superseded')"
MULE_ROLES = ("l1_mule", "l2_mule")
# Evaluation days relative to the first day of the data.
SPLIT_DAYS = {"train": (0, 6), "val": (6, 8), "test": (8, 10)}


@dataclass(frozen=True)
class Rules:
    """One rule version of the account detectors."""

    version: str = "r2.0"
    model_threshold: float = 0.86
    hop_rule: bool = True
    friction: bool = False
    friction_score: float = 0.95
    inflow_floor_p: int = 150_000 * PAISE
    inflow_mult: int = 3
    pass_floor_p: int = 100_000 * PAISE
    pass_ratio: float = 0.6
    pass_windows: tuple[int, ...] = (HOUR, 6 * HOUR, DAY)
    forwarder_ratio: float = 0.5
    forwarder_scale: int = 3
    near_cap_low: int = 90_000
    cap: int = 100_000
    baseline_days: int = 7
    baseline_min_active: int = 5
    ratio_min_inflow_p: int = 20_000 * PAISE
    rel_floor_p: int = 25_000 * PAISE
    own_mult: int = 3
    peer_busiest_p: dict[str, int] = field(default_factory=lambda: {"individual": 28_000 * PAISE, "supplier": 94_000 * PAISE})
    fan_in_payers: int = 5
    fan_in_min_p: int = 5_000 * PAISE
    hop_high_p: int = 100_000 * PAISE
    hop_min_p: int = 6_100 * PAISE
    hop_share: float = 0.5

    @property
    def relative_floor(self) -> bool:
        return self.version in ("r2.1", "r2.2")


R20 = Rules()
R21 = Rules(version="r2.1")
R22 = Rules(version="r2.2")


@dataclass(frozen=True)
class MerchantRules:
    """Merchant detectors. The category bar (p99) is a table, because it is calibrated per category."""

    version: str = "p1.0"
    d1_count: int = 3
    d2_states: int = 4
    d3_requests: int = 5
    d3_fail_share: float = 0.85
    own_days: int = 7
    own_min_tickets: int = 50
    established_days: int = 30
    hold_hours: int = 24
    hold_d4_hours: int = 72
    batch_hour: int = 6
    train_days: int = 6
    warmup_days: int = 3
    test_days: tuple[int, int] = (8, 10)
    local: tuple[str, ...] = ("kirana", "restaurant", "pharmacy", "fuel")


P10 = MerchantRules()


@dataclass(frozen=True)
class Split:
    """How hot keys are cut up: a key with more than `hot_rows` rows is windowed per `segment_us` of time."""

    hot_rows: int = 1_000_000
    segment_us: int = HOUR


SPLIT = Split()
