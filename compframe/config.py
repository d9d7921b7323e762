"""Thresholds of the valuation rules, in one place and overridable."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ValuationConfig:
    """Parameters of the comparables ladder and of deal building."""

    size_tolerance: float = 10.0     # m2 either side of the subject
    min_comparables: int = 3
    pps_low: float = 200.0           # exclusive
    pps_high: float = 5000.0         # exclusive
    similarity: float = 0.7
    size_bucket: float = 2.5         # width of the range-join bucket, m2
    pps_bucket: float = 50.0         # width of the first selection level, EUR/m2


@dataclass(frozen=True)
class AppraisalConfig:
    """Parameters of the older, top-k scoring method."""

    size_tolerance_pct: float = 25.0
    max_results: int = 15
    min_comparables: int = 3
    min_price: float = 5000.0
    max_price: float = 500000.0
    min_score: int = 3
    report_limit: int = 20


@dataclass(frozen=True)
class DuplicateConfig:
    """Weights and thresholds of the cross-agency duplicate score."""

    district_ratio: float = 0.80
    type_ratio: float = 0.85
    floor_ratio: float = 0.75
    area_near: float = 0.05
    area_far: float = 0.10
    price_near: float = 0.04
    price_far: float = 0.08
    min_confidence: float = 0.65


# Currency rates in use (leva per euro).
RATE_LIVE = 1.96
RATE_OFFICIAL = 1.95583

# Inclusive ingest ranges.
INGEST_SIZE = (15.0, 500.0)
INGEST_PPS = (200.0, 15000.0)
INGEST_PRICE = (10000.0, 2000000.0)
SALE_FLOOR = 15000.0

# Bookkeeping limits.
RETENTION_DAYS = 7
LEDGER_KEEP_DAYS = 2
MIN_LISTINGS_PER_SOURCE = 5
COVERAGE_ALARM_PCT = 20.0
PAGE_SIZE = 12
ALERT_LIMIT = 10
RATE_LIMIT_MAX = 5
RATE_LIMIT_WINDOW_S = 60
