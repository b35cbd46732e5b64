"""Thresholds of the rule sets: fixed values, as data, so that earlier versions and what-if policies use the same rules."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Stage1Policy:
    cap_reject: float = 150_000_000
    cap_watch: float = 500_000_000
    price_reject: float = 1.5
    price_watch: float = 3.0
    price_warn: float = 5.0
    volume_reject: float = 1_000_000
    volume_watch: float = 5_000_000
    asset_types: frozenset = frozenset({"common_stock"})
    allow_otc: bool = False
    exchanges: frozenset = frozenset({"NYSE", "NASDAQ", "AMEX", "ARCA", "CBOE", "LSE", "TSX", "XETRA", "EURONEXT", "SIX", "HKEX", "TSE", "ASX"})


@dataclass(frozen=True)
class Stage2Policy:
    complete_reject: float = 50
    complete_watch: float = 70
    operating_reject: float = -0.20
    operating_watch: float = 0.0
    fcf_reject: float = -0.10
    fcf_watch: float = 0.0
    debt_reject: float = 5.0
    debt_watch: float = 3.0
    dilution_reject: float = 0.30
    dilution_watch: float = 0.10
    exception_growth: float = 0.25
    exception_margin: float = 0.40
    missing_dilution_watches: bool = False
    special_sectors: frozenset = frozenset({"banks", "banking", "insurance", "reits", "reit", "biotechnology", "utilities", "mining", "financial services"})


@dataclass(frozen=True)
class Stage3Policy:
    risk_reject: float = 8.5
    risk_watch: float = 7.5
    quality_reject: float = 3.5
    quality_watch: float = 5.0
    final_reject: float = 45.0
    final_watch: float = 60.0
    risk_penalty: float = 0.5
    weights: dict = field(default_factory=lambda: {
        "business_quality_score": 0.20, "financial_health_score": 0.15, "growth_score": 0.15, "valuation_score": 0.15,
        "moat_proxy_score": 0.15, "momentum_score": 0.10, "data_quality_score": 0.10,
    })


STAGE1, STAGE2, STAGE3 = Stage1Policy(), Stage2Policy(), Stage3Policy()
#: The versions before these.
STAGE1_EARLIER = replace(STAGE1, cap_reject=100_000_000, cap_watch=300_000_000, price_reject=1.0, price_watch=3.0, volume_reject=500_000, volume_watch=2_000_000)
STAGE2_EARLIER = replace(STAGE2, missing_dilution_watches=True)

#: What-if policies: (cap reject, cap watch, price reject, price watch, price warn, volume reject, volume watch).
WHAT_IF = {
    "current_base": (100e6, 300e6, 1.0, 3.0, 5.0, 500e3, 2e6),
    "conservative": (300e6, 1e9, 2.0, 4.0, 8.0, 2e6, 10e6),
    "balanced": (150e6, 500e6, 1.5, 3.0, 5.0, 1e6, 5e6),
    "aggressive": (50e6, 150e6, 0.75, 1.5, 2.0, 250e3, 1e6),
}
#: Of the selection: target rates of passed, watched and rejected, and what each policy is worth beforehand.
TARGETS = (36.0, 15.0, 47.0)
PRIORS = {"current_base": 78.0, "conservative": 72.0, "balanced": 92.0, "aggressive": 58.0}
ADVICE = {"balanced": "CANDIDATE", "current_base": "BASELINE", "conservative": "ALTERNATIVE_STRICT", "aggressive": "NOT_RECOMMENDED"}

#: Hard filters of the quant pipeline.
MIN_PRICE, MIN_MARKET_CAP, MIN_AVG_VOLUME, MIN_QUALITY = 2, 100_000_000, 300_000, 60
#: Weights (metadata, market, fundamentals) of the combined score and of the sensitivity study.
SENSITIVITY = {
    "current_20_35_45": (0.20, 0.35, 0.45),
    "balanced_25_35_40": (0.25, 0.35, 0.40),
    "market_heavier_20_45_35": (0.20, 0.45, 0.35),
    "fundamentals_heavier_15_30_55": (0.15, 0.30, 0.55),
    "metadata_lighter_10_40_50": (0.10, 0.40, 0.50),
}
