"""The three-stage funnel: rule cascades, scores and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.rules import REJECT, WARN, WATCH, Rule, classified, first_of
from ..plans.policies import STAGE1, STAGE2, STAGE3, Stage1Policy, Stage2Policy, Stage3Policy


def band(metric: str, value: Column, reject: float, watch: float, codes: tuple[str, str, str], below: bool = True, hard: Column | None = None) -> list[Rule]:
    """Missing, beyond ``reject``, beyond ``watch``; missing rejects, where ``codes[0]`` is given."""
    beyond = (lambda t: value < t) if below else (lambda t: value > t)
    out = [Rule(codes[0], value.isNull(), REJECT, metric, value, "required", "high")] if codes[0] else []
    return [*out, Rule(codes[1], beyond(reject), REJECT, metric, value, reject, "high", False), Rule(codes[2], ~beyond(reject) & beyond(watch), WATCH, metric, value, watch)]


def dollar_volume() -> Column:
    return F.coalesce(X.real("dollar_volume_90d"), X.real("price") * X.real("avg_volume_90d"))


def stage1_rules(p: Stage1Policy = STAGE1) -> list[Rule]:
    ticker, asset, exchange = X.ticker("ticker"), F.lower(X.text("asset_type")), F.upper(X.text("exchange"))
    cap, price, volume = X.real("market_cap"), X.real("price"), dollar_volume()
    otc = exchange.contains("OTC") | (exchange == "PINK")
    return [
        Rule("MISSING_TICKER", ticker == "", REJECT, "ticker", ticker, "required", "critical", False),
        Rule("INACTIVE_SECURITY", X.tri_state("is_active").eqNullSafe(False), REJECT, "is_active", F.col("is_active"), "true", "critical", False),
        Rule("NOT_COMMON_STOCK", ~asset.isin(*p.asset_types), REJECT, "asset_type", asset, p.asset_types, "high", False),
        *([] if p.allow_otc else [Rule("OTC_NOT_ALLOWED", otc, REJECT, "exchange", exchange, "non-OTC", "high", False)]),
        Rule("MISSING_EXCHANGE", exchange == "", WATCH, "exchange", exchange, "known exchange"),
        Rule("EXCHANGE_NOT_IN_ALLOWED_LIST", (exchange != "") & ~exchange.isin(*p.exchanges), WATCH, "exchange", exchange, p.exchanges),
        *band("market_cap", cap, p.cap_reject, p.cap_watch, ("MISSING_MARKET_CAP", "MARKET_CAP_BELOW_MINIMUM", "MARKET_CAP_WATCHLIST_RANGE")),
        *band("price", price, p.price_reject, p.price_watch, ("MISSING_PRICE", "PRICE_BELOW_MINIMUM", "PRICE_STRONG_WATCHLIST_RANGE")),
        Rule("PRICE_WEAK_WATCHLIST_RANGE", (price >= p.price_reject) & (price >= p.price_watch) & (price < p.price_warn), WARN, "price", price, p.price_warn, "low"),
        *band("dollar_volume_90d", volume, p.volume_reject, p.volume_watch, ("MISSING_DOLLAR_VOLUME", "LOW_DOLLAR_VOLUME", "DOLLAR_VOLUME_WATCHLIST_RANGE")),
    ]


def stage1(df: DataFrame, policy: Stage1Policy = STAGE1) -> DataFrame:
    """``df`` with its Stage 1 status and reasons."""
    return classified(with_missing(df, {"dollar_volume_90d": "double"}), stage1_rules(policy), "stage1")


def special_case(p: Stage2Policy = STAGE2) -> Column:
    """C3."""
    return X.special_state("special_case") | F.lower(X.text("sector")).isin(*p.special_sectors) | F.lower(X.text("industry")).isin(*p.special_sectors)


def growth_exception(p: Stage2Policy = STAGE2) -> Column:
    """C4."""
    growth, margin, debt = X.real("revenue_growth_3y"), X.real("gross_margin"), X.real("net_debt_to_ebitda")
    return F.coalesce((growth >= p.exception_growth) & (margin >= p.exception_margin), F.lit(False)) & ~F.coalesce(debt > p.debt_reject, F.lit(False))


def stage2_rules(p: Stage2Policy = STAGE2) -> list[Rule]:
    special, excused = special_case(p), special_case(p) | growth_exception(p)
    complete, revenue, debt, dilution = (X.real(c) for c in ("data_completeness_score", "revenue_ttm", "net_debt_to_ebitda", "shares_dilution_3y"))

    def margin(name: str, label: str, reject: float, watch: float) -> list[Rule]:
        x = X.real(name)
        return [
            Rule(f"MISSING_{label}", x.isNull(), WATCH, name, x, "required for clean pass"),
            Rule(f"{label}_TOO_NEGATIVE_BUT_RECOVERABLE", (x < reject) & excused, WATCH, name, x, reject),
            Rule(f"{label}_TOO_NEGATIVE", (x < reject) & ~excused, REJECT, name, x, reject, "high"),
            Rule(f"{label}_WATCHLIST_RANGE", (x >= reject) & (x < watch), WATCH, name, x, watch),
        ]

    missing_dilution = "MISSING_SHARES_DILUTION" if p.missing_dilution_watches else "MISSING_SHARES_DILUTION_PROVIDER_LIMITATION"
    return [
        *band("data_completeness_score", complete, p.complete_reject, p.complete_watch, ("MISSING_DATA_COMPLETENESS", "LOW_DATA_COMPLETENESS", "DATA_COMPLETENESS_WATCHLIST_RANGE")),
        Rule("MISSING_FINANCIAL_DATA_DATE", X.is_blank("financial_data_date"), WATCH, "financial_data_date", F.col("financial_data_date"), "required"),
        Rule("MISSING_REVENUE_SPECIAL_CASE", revenue.isNull() & special, WATCH, "revenue_ttm", revenue, "revenue_ttm > 0 unless special_case"),
        Rule("MISSING_REVENUE", revenue.isNull() & ~special, REJECT, "revenue_ttm", revenue, "revenue_ttm > 0", "high"),
        Rule("REVENUE_NOT_POSITIVE_SPECIAL_CASE", (revenue <= 0) & special, WATCH, "revenue_ttm", revenue, "revenue_ttm > 0 unless special_case"),
        Rule("REVENUE_NOT_POSITIVE", (revenue <= 0) & ~special, REJECT, "revenue_ttm", revenue, "> 0", "high", False),
        *margin("operating_margin", "OPERATING_MARGIN", p.operating_reject, p.operating_watch),
        *margin("fcf_margin", "FCF_MARGIN", p.fcf_reject, p.fcf_watch),
        Rule("MISSING_NET_DEBT_TO_EBITDA", debt.isNull(), WATCH, "net_debt_to_ebitda", debt, "required for clean pass"),
        Rule("DEBT_TOO_HIGH", ~special & (debt > p.debt_reject), REJECT, "net_debt_to_ebitda", debt, p.debt_reject, "high"),
        Rule("DEBT_WATCHLIST_RANGE", ~special & (debt <= p.debt_reject) & (debt > p.debt_watch), WATCH, "net_debt_to_ebitda", debt, p.debt_watch),
        Rule(missing_dilution, dilution.isNull(), WATCH if p.missing_dilution_watches else WARN, "shares_dilution_3y", dilution, "provider limitation", "low"),
        Rule("HIGH_DILUTION", dilution > p.dilution_reject, REJECT, "shares_dilution_3y", dilution, p.dilution_reject, "high"),
        Rule("DILUTION_WATCHLIST_RANGE", (dilution <= p.dilution_reject) & (dilution > p.dilution_watch), WATCH, "shares_dilution_3y", dilution, p.dilution_watch),
    ]


STAGE2_COLUMNS = {
    **dict.fromkeys(("revenue_ttm", "revenue_growth_1y", "revenue_growth_3y", "gross_margin", "operating_margin", "net_margin", "ebitda", "free_cash_flow", "fcf_margin", "total_debt", "cash", "net_debt",
                     "net_debt_to_ebitda", "debt_to_equity", "current_ratio", "interest_coverage", "shares_dilution_3y", "data_completeness_score"), "double"),
    "financial_data_date": "string", "special_case": "boolean", "sector": "string", "industry": "string",
}
STAGE3_COLUMNS = dict.fromkeys(("pe_ratio", "forward_pe", "ev_ebitda", "price_sales", "fcf_yield", "price_change_6m", "price_change_12m", "relative_strength_6m", "drawdown_from_52w_high"), "double")


def with_missing(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with null columns for those of ``kinds`` that it has not."""
    absent = {c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def stage2(df: DataFrame, policy: Stage2Policy = STAGE2) -> DataFrame:
    """C2."""
    return classified(with_missing(df, STAGE2_COLUMNS), stage2_rules(policy), "stage2")


def stage3_blocks() -> dict[str, Column]:
    """K6: the nine block scores, 0 to 10, rounded."""
    m = {c: X.real(c) for c in (*STAGE2_COLUMNS, *STAGE3_COLUMNS, "dollar_volume_90d") if {**STAGE2_COLUMNS, **STAGE3_COLUMNS}.get(c, "double") == "double"}
    up, down = X.scale10, X.inverse10
    mean = lambda *p: reduce(lambda a, b: a + b, p) / float(len(p))
    positive = lambda c, lo, hi: F.when(m[c] > 0, down(m[c], lo, hi))
    given = lambda c, e: F.when(c.isNotNull(), e)
    fall = F.abs(m["drawdown_from_52w_high"])
    blocks = {
        "business_quality_score": mean(up(m["gross_margin"], 0.20, 0.70), up(m["operating_margin"], 0.0, 0.35), up(m["net_margin"], 0.0, 0.30), up(m["fcf_margin"], 0.0, 0.30)),
        "financial_health_score": mean(down(m["net_debt_to_ebitda"], 0.0, 5.0), up(m["interest_coverage"], 2.0, 25.0), up(m["current_ratio"], 0.8, 2.0), down(m["shares_dilution_3y"], -0.05, 0.30)),
        "growth_score": mean(up(m["revenue_growth_1y"], -0.05, 0.25), up(m["revenue_growth_3y"], 0.0, 0.25)),
        "valuation_score": X.mean_present(given(m["fcf_yield"], up(m["fcf_yield"], 0.02, 0.10)), positive("pe_ratio", 10.0, 45.0), positive("ev_ebitda", 6.0, 30.0), positive("price_sales", 2.0, 20.0), default=4.5),
        "risk_score": X.mean_present(up(m["net_debt_to_ebitda"], 0.0, 6.0), down(m["fcf_margin"], -0.20, 0.20), up(m["shares_dilution_3y"], -0.05, 0.40), down(m["data_completeness_score"], 40.0, 100.0), given(fall, up(fall, 0.05, 0.60))),
        "moat_proxy_score": mean(up(m["gross_margin"], 0.25, 0.75), up(m["operating_margin"], 0.05, 0.35), up(m["fcf_margin"], 0.0, 0.30), up(m["revenue_growth_3y"], 0.02, 0.18)),
        "momentum_score": X.mean_present(given(m["price_change_6m"], up(m["price_change_6m"], -0.20, 0.40)), given(m["relative_strength_6m"], up(m["relative_strength_6m"], -0.20, 0.30)), given(fall, down(fall, 0.05, 0.60)), default=5.0),
        "liquidity_score": up(m["dollar_volume_90d"], 500_000.0, 50_000_000.0),
        "data_quality_score": up(m["data_completeness_score"], 50.0, 100.0),
    }
    return {c: X.rounded(X.clamp(e, 0.0, 10.0)) for c, e in blocks.items()}


def stage3_final(p: Stage3Policy = STAGE3) -> Column:
    """K7."""
    total = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in p.weights.items()])
    return X.rounded(X.clamp(total * 10.0 - F.col("risk_score") * p.risk_penalty))


#: Category labels.
STRONG, DEMANDING, CONDITIONAL, RISKY, THIN, DROPPED = "🟢 Candidata fuerte para scouting", "🔵 Alta calidad pero valoración exigente", "🟡 Interesante con condiciones", "🟠 Riesgo elevado / revisar con cuidado", "⚫ Datos insuficientes pero potencial", "🔴 Descartada por scoring"


def stage3(df: DataFrame, policy: Stage3Policy = STAGE3) -> DataFrame:
    """Blocks, final score, status, category and reasons."""
    p = policy
    df = with_missing(df, {**STAGE2_COLUMNS, **STAGE3_COLUMNS, "dollar_volume_90d": "double"})
    df = df.withColumns(stage3_blocks()).withColumn("final_stage3_score", stage3_final(p))
    risk, quality, final, business, moat, value = (F.col(c) for c in ("risk_score", "data_quality_score", "final_stage3_score", "business_quality_score", "moat_proxy_score", "valuation_score"))
    out = [risk > p.risk_reject, quality < p.quality_reject, final < p.final_reject]
    ok = ~(out[0] | out[1] | out[2])
    rules = [  # the first that rejects is the only reason
        Rule("HIGH_RISK_SCORE", out[0], REJECT, "risk_score", risk, p.risk_reject, "high"),
        Rule("LOW_DATA_QUALITY", ~out[0] & out[1], REJECT, "data_quality_score", quality, p.quality_reject, "high"),
        Rule("LOW_FINAL_SCORE", ~out[0] & ~out[1] & out[2], REJECT, "final_stage3_score", final, p.final_reject),
        Rule("RISK_SCORE_WATCHLIST_RANGE", ok & (risk > p.risk_watch), WATCH, "risk_score", risk, p.risk_watch),
        Rule("DATA_QUALITY_WATCHLIST_RANGE", ok & (quality < p.quality_watch), WATCH, "data_quality_score", quality, p.quality_watch),
        Rule("FINAL_SCORE_WATCHLIST_RANGE", ok & (final < p.final_watch), WATCH, "final_stage3_score", final, p.final_watch),
    ]
    category = first_of([
        (DROPPED, ~ok), (THIN, quality < p.quality_watch), (RISKY, risk > p.risk_watch), (CONDITIONAL, final < p.final_watch),
        (DEMANDING, (business >= 7.0) & (moat >= 7.0) & (value < 5.0)), (STRONG, (final >= 70.0) & (business >= 6.5)),
    ], CONDITIONAL)
    return classified(df, rules, "stage3").withColumn("stage3_category", category)


def _best(df: DataFrame, wanted: Column, n: int, key: str) -> DataFrame:
    """The ``n`` rows of the best final score that are ``wanted``; ``key`` breaks ties.

    What is not wanted is ordered last and dropped after the limit: a condition before it would go down through all projections
    and take a copy of the whole cascade for each column that it names.
    """
    rows = df.withColumn("__wanted", F.coalesce(wanted, F.lit(False)))
    return rows.orderBy(F.desc("__wanted"), F.desc("final_stage3_score"), key).limit(n).where("__wanted").drop("__wanted")


def top_candidates(df: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    """The best of passed and watched; ``key`` breaks ties."""
    return _best(df, F.col("stage3_status").isin("PASSED", WATCH), n, key)


def top_recoverable(df: DataFrame, n: int = 100, key: str = "ticker") -> DataFrame:
    """T3."""
    return _best(df, F.col("stage3_status").isin(WATCH, REJECT) & (F.col("stage3_primary_reason") != ""), n, key)


def stage_summary(df: DataFrame, stage: str) -> DataFrame:
    """A1: counts and rates of a classified frame, one row."""
    n, s = F.count(F.lit(1)), F.col(f"{stage}_status")
    counts = {k: F.count(F.when(s == v, 1)) for k, v in (("passed", "PASSED"), ("watchlist", WATCH), ("rejected", REJECT))}
    rates = {f"{k}_rate": F.when(n > 0, v / n).otherwise(0.0) for k, v in counts.items()}
    return df.agg(n.alias("companies"), *[v.alias(k) for k, v in counts.items()], *[v.alias(k) for k, v in rates.items()])


def what_if_rules(cap: Column, price: Column, volume: Column, t: tuple[Column, ...], generation: int = 3) -> list[Rule]:
    """The numeric rules with thresholds from columns.  Generation 1 watches below one price, 2 has no weak range, 3 has both ranges."""
    weak = Rule("PRICE_WEAK_WATCHLIST_RANGE", (price >= t[2]) & (price >= t[3]) & (price < t[4]), WARN)
    return [
        Rule("MISSING_MARKET_CAP", cap.isNull(), REJECT), Rule("MARKET_CAP_BELOW_MINIMUM", cap < t[0], REJECT),
        Rule("MISSING_PRICE", price.isNull(), REJECT), Rule("PRICE_BELOW_MINIMUM", price < t[2], REJECT),
        Rule("MISSING_DOLLAR_VOLUME", volume.isNull(), REJECT), Rule("LOW_DOLLAR_VOLUME", volume < t[5], REJECT),
        Rule("MARKET_CAP_WATCHLIST_RANGE", (cap >= t[0]) & (cap < t[1]), WATCH),
        Rule("PRICE_STRONG_WATCHLIST_RANGE" if generation == 3 else "PRICE_WATCHLIST_RANGE", (price >= t[2]) & (price < t[3]), WATCH),
        Rule("DOLLAR_VOLUME_WATCHLIST_RANGE", (volume >= t[5]) & (volume < t[6]), WATCH),
        *([weak] if generation == 3 else []),
    ]


def what_if(df: DataFrame, policies: dict[str, tuple[float, ...]], generation: int = 3) -> DataFrame:
    """Every row under every policy (a handful of rows, exploded beside each row): scenario, decision, reasons, weak_reasons."""
    from ..functions import rules as R

    names = ("t0", "t1", "t2", "t3", "t4", "t5", "t6")
    table = F.array(*[F.struct(F.lit(k).alias("scenario"), *[F.lit(float(x)).alias(n) for n, x in zip(names, v, strict=True)]) for k, v in policies.items()])
    rows = df.withColumn("policy", F.explode(table)).withColumn("__volume", dollar_volume())
    rules = what_if_rules(X.real("market_cap"), X.real("price"), F.col("__volume"), tuple(F.col(f"policy.{n}") for n in names), generation)
    return rows.withColumns({
        "scenario": F.col("policy.scenario"), "decision": R.status(rules), "reasons": R.codes(rules, ", "),
        "weak_reasons": R.codes([r for r in rules if r.effect == WARN], ", "),
    }).drop("policy", "__volume")


def policy_rates(decisions: DataFrame) -> DataFrame:
    """A9."""
    n = F.count(F.lit(1))
    count = lambda v: F.count(F.when(F.col("decision") == v, 1))
    out = decisions.groupBy("scenario").agg(n.alias("total"), count("PASSED").alias("passed"), count(WATCH).alias("watchlist"), count(REJECT).alias("rejected"))
    return out.withColumns({f"{k}_rate_percent": X.rate(F.col(c), F.col("total")) for k, c in (("pass", "passed"), ("watchlist", "watchlist"), ("rejection", "rejected"))})


def policy_decision(rates: DataFrame) -> DataFrame:
    """Each policy's decision score and advice."""
    from ..plans.policies import ADVICE, PRIORS, TARGETS

    near = lambda c, target, k: F.greatest(F.lit(0.0), 100.0 - F.abs(F.col(c) - target) * k)
    prior = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORS.items() for x in kv]), F.col("scenario")), F.lit(70.0))
    score = near("pass_rate_percent", TARGETS[0], 3.0) * 0.35 + near("watchlist_rate_percent", TARGETS[1], 4.0) * 0.20 + near("rejection_rate_percent", TARGETS[2], 2.0) * 0.25 + prior * 0.20
    return rates.withColumn("decision_score", X.rounded(score)).withColumn("recommendation", X.mapped("scenario", ADVICE, F.lit("REVIEW")))
