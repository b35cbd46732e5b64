"""Registered queries: the operators bound to the driver's tables, each with SQL that says the same in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bindings as B
from .functions import exprs as X
from .functions.rules import reason_log
from .operators import diagnostics, market, memo, reports, scoring, stages, universe, views
from .operators.orderings import settled
from .plans import pipelines, policies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = B.plain(sql) if "{" in sql else sql
        return f

    return register


def r2(e: str) -> str:
    return f"floor(({e}) * 100e0 + 5e-1) / 100e0"


def case(*rules: tuple[str, str], default: str = "null") -> str:
    return "case " + " ".join(f"when {w} then {v}" for w, v in rules) + f" else {default} end"


# ---------------------------------------------------------------- Stage 1

_U = f"(select *, coalesce(dollar_volume_90d, price * avg_volume_90d) as dv, upper(trim(exchange)) as ex, lower(trim(asset_type)) as aty, lower(trim(is_active)) as act from ({B.UNIVERSE}) b)"
_S1_RULES = [  # (code, condition, effect)
    ("MISSING_TICKER", "trim(ticker) = ''", "R"), ("INACTIVE_SECURITY", "coalesce(act in ('no', 'false', '0'), false)", "R"), ("NOT_COMMON_STOCK", "aty <> 'common_stock'", "R"),
    ("OTC_NOT_ALLOWED", "(ex like '%OTC%' or ex = 'PINK')", "R"), ("MISSING_EXCHANGE", "ex = ''", "W"),
    ("EXCHANGE_NOT_IN_ALLOWED_LIST", "(ex <> '' and ex not in ('NYSE','NASDAQ','AMEX','ARCA','CBOE','LSE','TSX','XETRA','EURONEXT','SIX','HKEX','TSE','ASX'))", "W"),
    ("MISSING_MARKET_CAP", "market_cap is null", "R"), ("MARKET_CAP_BELOW_MINIMUM", "market_cap < 150000000", "R"), ("MARKET_CAP_WATCHLIST_RANGE", "(market_cap >= 150000000 and market_cap < 500000000)", "W"),
    ("MISSING_PRICE", "price is null", "R"), ("PRICE_BELOW_MINIMUM", "price < 15e-1", "R"), ("PRICE_STRONG_WATCHLIST_RANGE", "(price >= 15e-1 and price < 3e0)", "W"), ("PRICE_WEAK_WATCHLIST_RANGE", "(price >= 3e0 and price < 5e0)", "N"),
    ("MISSING_DOLLAR_VOLUME", "dv is null", "R"), ("LOW_DOLLAR_VOLUME", "dv < 1000000", "R"), ("DOLLAR_VOLUME_WATCHLIST_RANGE", "(dv >= 1000000 and dv < 5000000)", "W"),
]


def _status(rules: list[tuple[str, str, str]]) -> str:
    either = lambda e: " or ".join(f"coalesce({c}, false)" for _, c, x in rules if x == e)
    return f"case when {either('R')} then 'REJECTED' when {either('W')} then 'WATCHLIST' else 'PASSED' end"


def _codes(rules: list[tuple[str, str, str]], sep: str = "|") -> str:
    return f"concat_ws('{sep}', " + ", ".join(f"case when {c} then '{k}' end" for k, c, _ in rules) + ")"


_S1 = f"(select *, {_status(_S1_RULES)} as stage1_status, {_codes(_S1_RULES)} as stage1_all_reasons from {_U} u)"


def _stage1(spark: SparkSession, d: str) -> DataFrame:
    return stages.stage1(B.frame(spark, d, B.UNIVERSE))


@query(f"select k, stage1_status, split_part(stage1_all_reasons, '|', 1) as stage1_primary_reason, stage1_all_reasons from {_S1} s")
def stage1_status(spark: SparkSession, d: str) -> DataFrame:
    """C1 over the whole universe."""
    return _stage1(spark, d).select("k", "stage1_status", "stage1_primary_reason", "stage1_all_reasons")


_S1_TEXTS = {  # as the rules word them
    "MISSING_TICKER": "Ticker missing.", "INACTIVE_SECURITY": "Security is not active.", "NOT_COMMON_STOCK": "Asset type is not allowed for Stage 1.", "OTC_NOT_ALLOWED": "OTC/Pink Sheet security excluded in Stage 1.",
    "MISSING_EXCHANGE": "Exchange missing.", "EXCHANGE_NOT_IN_ALLOWED_LIST": "Exchange is not in the default allowed list.", "MISSING_MARKET_CAP": "Market cap missing.", "MARKET_CAP_BELOW_MINIMUM": "Market cap below Stage 1 minimum.",
    "MARKET_CAP_WATCHLIST_RANGE": "Market cap is below pass threshold but above rejection threshold.", "MISSING_PRICE": "Price missing.", "PRICE_BELOW_MINIMUM": "Price below Stage 1 minimum.",
    "PRICE_STRONG_WATCHLIST_RANGE": "Price is below pass threshold but above rejection threshold.", "PRICE_WEAK_WATCHLIST_RANGE": "Price is below weak warning threshold but does not trigger watchlist by itself.",
    "MISSING_DOLLAR_VOLUME": "Dollar volume cannot be calculated.", "LOW_DOLLAR_VOLUME": "Dollar volume below Stage 1 minimum.", "DOLLAR_VOLUME_WATCHLIST_RANGE": "Dollar volume is below pass threshold but above rejection threshold.",
}


@query(f"select k, status, reason_code, {case(*[(f"reason_code = '{c}'", f"'{t}'") for c, t in _S1_TEXTS.items()])} as reason_text from (select k, stage1_status as status, unnest(string_split(stage1_all_reasons, '|')) as reason_code from {_S1} s where stage1_all_reasons <> '') x")
def stage1_reason_log(spark: SparkSession, d: str) -> DataFrame:
    """The rejection log: a row for each reason, with its text."""
    return reason_log(_stage1(spark, d), "stage1", ["k"]).select("k", "status", "reason_code", "reason_text")


@query(f"select reason_code, count(*) as count from (select unnest(string_split(stage1_all_reasons, '|')) as reason_code from {_S1} s where stage1_all_reasons <> '') x group by 1 order by 2 desc, 1 limit 20")
def stage1_top_reasons(spark: SparkSession, d: str) -> DataFrame:
    """A2: the twenty most frequent reasons (a report)."""
    return reports.value_counts(reason_log(_stage1(spark, d), "stage1", ["k"]), "reason_code")


@query(f"""select count(*) as companies, count(*) filter (stage1_status = 'PASSED') as passed, count(*) filter (stage1_status = 'WATCHLIST') as watchlist, count(*) filter (stage1_status = 'REJECTED') as rejected,
count(*) filter (stage1_status = 'PASSED') / count(*) as passed_rate, count(*) filter (stage1_status = 'WATCHLIST') / count(*) as watchlist_rate, count(*) filter (stage1_status = 'REJECTED') / count(*) as rejected_rate from {_S1} s""")
def stage1_summary(spark: SparkSession, d: str) -> DataFrame:
    """A1."""
    return stages.stage_summary(_stage1(spark, d), "stage1")


_EARLIER = [(k, c.replace("150000000", "100000000").replace("500000000", "300000000").replace("15e-1", "1e0").replace("dv < 1000000", "dv < 500000").replace("dv >= 1000000 and dv < 5000000", "dv >= 500000 and dv < 2000000"), e) for k, c, e in _S1_RULES]


@query(f"select stage1_status, count(*) as count from (select {_status(_EARLIER)} as stage1_status from {_U} u) s group by 1")
def stage1_earlier_policy(spark: SparkSession, d: str) -> DataFrame:
    """The same rules under the earlier thresholds."""
    return reports.group_counts(stages.stage1(B.frame(spark, d, B.UNIVERSE), policies.STAGE1_EARLIER), "stage1_status")


_WI = "(select * from (values " + ", ".join("('" + k + "', " + ", ".join(f"{x:.2f}e0" for x in v) + ")" for k, v in policies.WHAT_IF.items()) + ") p(scenario, t0, t1, t2, t3, t4, t5, t6))"
_WI_RULES = [
    ("MISSING_MARKET_CAP", "market_cap is null", "R"), ("MARKET_CAP_BELOW_MINIMUM", "market_cap < t0", "R"), ("MISSING_PRICE", "price is null", "R"), ("PRICE_BELOW_MINIMUM", "price < t2", "R"),
    ("MISSING_DOLLAR_VOLUME", "dv is null", "R"), ("LOW_DOLLAR_VOLUME", "dv < t5", "R"), ("MARKET_CAP_WATCHLIST_RANGE", "(market_cap >= t0 and market_cap < t1)", "W"),
    ("PRICE_STRONG_WATCHLIST_RANGE", "(price >= t2 and price < t3)", "W"), ("DOLLAR_VOLUME_WATCHLIST_RANGE", "(dv >= t5 and dv < t6)", "W"), ("PRICE_WEAK_WATCHLIST_RANGE", "(price >= t2 and price >= t3 and price < t4)", "N"),
]
_WIS = f"(select k, scenario, {_status(_WI_RULES)} as decision, {_codes(_WI_RULES, ', ')} as reasons from {_U} u cross join {_WI} w)"
_RATES = f"""(select scenario, total, passed, watchlist, rejected, {r2('passed * 1e0 / total * 100e0')} as pass_rate_percent, {r2('watchlist * 1e0 / total * 100e0')} as watchlist_rate_percent, {r2('rejected * 1e0 / total * 100e0')} as rejection_rate_percent
from (select scenario, count(*) as total, count(*) filter (decision = 'PASSED') as passed, count(*) filter (decision = 'WATCHLIST') as watchlist, count(*) filter (decision = 'REJECTED') as rejected from {_WIS} s group by 1) t)"""


@query(f"select k, scenario, decision, reasons from {_WIS} s")
def policy_whatif(spark: SparkSession, d: str) -> DataFrame:
    """Every listing under four policies."""
    return stages.what_if(B.frame(spark, d, B.UNIVERSE), policies.WHAT_IF).select("k", "scenario", "decision", "reasons")


@query(f"select scenario, reason, count(*) as count from (select scenario, trim(unnest(string_split(reasons, ','))) as reason from {_WIS} s where reasons <> '') x group by 1, 2")
def policy_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """A4."""
    return reports.reason_counts(policy_whatif(spark, d), "reasons", "scenario")


_near = lambda c, t, k: f"greatest(0e0, 100e0 - abs({c} - {t}e0) * {k}e0)"


@query(f"""select *, {r2(_near('pass_rate_percent', 36, 3) + ' * 35e-2 + ' + _near('watchlist_rate_percent', 15, 4) + ' * 2e-1 + ' + _near('rejection_rate_percent', 47, 2) + " * 25e-2 + case scenario when 'current_base' then 78e0 when 'conservative' then 72e0 when 'balanced' then 92e0 else 58e0 end * 2e-1")} as decision_score,
case scenario when 'balanced' then 'CANDIDATE' when 'current_base' then 'BASELINE' when 'conservative' then 'ALTERNATIVE_STRICT' else 'NOT_RECOMMENDED' end as recommendation from {_RATES} r""")
def policy_decision(spark: SparkSession, d: str) -> DataFrame:
    """A9, K17."""
    return pipelines.policy_study(B.frame(spark, d, B.UNIVERSE))[2]


_ALIGN = f"(select coalesce(r.k, s.k) as k, r.stage1_status as real_decision, s.decision as simulated_decision, case when r.k is null then 'right_only' when s.k is null then 'left_only' else 'both' end as merge_side from (select k, stage1_status from {_S1} a where trim(ticker) <> '') r full outer join (select k, decision from {_WIS} b where scenario = 'balanced' and reasons not like '%MISSING_MARKET_CAP%') s on r.k = s.k)"


def _alignment(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    real = _stage1(spark, d).where("trim(ticker) <> ''").select("k", F.col("stage1_status").alias("real_decision"))
    simulated = policy_whatif(spark, d).where("scenario = 'balanced' and reasons not like '%MISSING_MARKET_CAP%'").select("k", F.col("decision").alias("simulated_decision"))
    return pipelines.alignment(real, simulated, "k")


@query(f"select * from {_ALIGN} a")
def alignment_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Two decisions side by side.  The remainders leave each side rows that the other has not."""
    return _alignment(spark, d)[0]


@query(f"select real_decision, simulated_decision, merge_side, count(*) as count from {_ALIGN} a where real_decision is distinct from simulated_decision group by 1, 2, 3")
def alignment_mismatch_summary(spark: SparkSession, d: str) -> DataFrame:
    """X6, A3."""
    return _alignment(spark, d)[1]


@query(f"select coalesce(a.stage1_status, 'UNKNOWN') || '->' || b.decision as transition, count(*) as count from (select k, decision from {_WIS} w where scenario = 'conservative') b left join {_S1} a on a.k = b.k group by 1")
def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    """J10, A5."""
    after = policy_whatif(spark, d).where("scenario = 'conservative'").select("k", "decision")
    return reports.group_counts(views.transitions(_stage1(spark, d), after, "k", "stage1_status", "decision"), "transition")


@query(f"""select market_cap_bucket, stage1_status, count(*) as count from (select stage1_status, {case(('market_cap is null', "'missing'"), ('market_cap < 1e8', "'<100M'"), ('market_cap < 3e8', "'100M-300M'"), ('market_cap < 1e9', "'300M-1B'"), ('market_cap < 1e10', "'1B-10B'"), ('market_cap < 5e10', "'10B-50B'"), default="'>50B'")} as market_cap_bucket from {_S1} s) b group by 1, 2""")
def bucket_decision(spark: SparkSession, d: str) -> DataFrame:
    """F13, A3, X12."""
    return reports.group_counts(reports.bucketed(_stage1(spark, d)), "market_cap_bucket", "stage1_status")


_prof = lambda c: f"select '{c}' as metric, count({c}) as count, " + ", ".join(f"floor(({e}) * 1e4 + 5e-1) / 1e4 as {n}" for n, e in (("min", f"min({c})"), ("p25", f"quantile_cont({c}, 0.25)"), ("median", f"quantile_cont({c}, 0.5)"), ("p75", f"quantile_cont({c}, 0.75)"), ("max", f"max({c})"))) + f" from {_U} u"


@query(" union all ".join(map(_prof, ("market_cap", "price", "avg_volume_90d"))))
def numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    """A7 (the mean, whose last digits hang on the order of addition, is left to the tests)."""
    return reports.numeric_profile(B.frame(spark, d, B.UNIVERSE), ["market_cap", "price", "avg_volume_90d"]).drop("mean")


@query(f"select stage1_status, count(*) as count, median(price) as median_price, median(market_cap) as median_market_cap from {_S1} s group by 1")
def group_medians(spark: SparkSession, d: str) -> DataFrame:
    """A8."""
    return reports.group_medians(_stage1(spark, d), "stage1_status", ["price", "market_cap"])


@query(f"select w.k, r.reasons from (select k from {_S1} s where stage1_status = 'WATCHLIST') w left join (select k, string_agg(reason_code, ', ' order by reason_code) as reasons from (select distinct k, unnest(string_split(stage1_all_reasons, '|')) as reason_code from {_S1} s where stage1_all_reasons <> '') x group by 1) r on r.k = w.k")
def reasons_per_ticker(spark: SparkSession, d: str) -> DataFrame:
    """J18, A6."""
    first = _stage1(spark, d)
    return views.with_reasons(first.where("stage1_status = 'WATCHLIST'").select("k"), reason_log(first, "stage1", ["k"]), "k")


# ---------------------------------------------------------------- Stage 2 and 3

_FB = f"(select *, coalesce(lower(trim(special_case)) in ('yes', 'true', '1'), false) or lower(industry) in ('insurance') or lower(sector) in ('insurance') as sp, coalesce(revenue_growth_3y >= 25e-2 and gross_margin >= 4e-1, false) and not coalesce(net_debt_to_ebitda > 5e0, false) as gx from ({B.FUNDAMENTALS}) f)"


def _margin(c: str, label: str, low: str) -> list[tuple[str, str, str]]:
    return [(f"MISSING_{label}", f"{c} is null", "W"), (f"{label}_TOO_NEGATIVE_BUT_RECOVERABLE", f"({c} < {low} and (sp or gx))", "W"), (f"{label}_TOO_NEGATIVE", f"({c} < {low} and not (sp or gx))", "R"), (f"{label}_WATCHLIST_RANGE", f"({c} >= {low} and {c} < 0e0)", "W")]


_S2_RULES = [
    ("MISSING_DATA_COMPLETENESS", "data_completeness_score is null", "R"), ("LOW_DATA_COMPLETENESS", "data_completeness_score < 50", "R"), ("DATA_COMPLETENESS_WATCHLIST_RANGE", "(data_completeness_score >= 50 and data_completeness_score < 70)", "W"),
    ("MISSING_FINANCIAL_DATA_DATE", "coalesce(trim(financial_data_date), '') = ''", "W"),
    ("MISSING_REVENUE_SPECIAL_CASE", "(revenue_ttm is null and sp)", "W"), ("MISSING_REVENUE", "(revenue_ttm is null and not sp)", "R"), ("REVENUE_NOT_POSITIVE_SPECIAL_CASE", "(revenue_ttm <= 0 and sp)", "W"), ("REVENUE_NOT_POSITIVE", "(revenue_ttm <= 0 and not sp)", "R"),
    *_margin("operating_margin", "OPERATING_MARGIN", "-2e-1"), *_margin("fcf_margin", "FCF_MARGIN", "-1e-1"),
    ("MISSING_NET_DEBT_TO_EBITDA", "net_debt_to_ebitda is null", "W"), ("DEBT_TOO_HIGH", "(not sp and net_debt_to_ebitda > 5e0)", "R"), ("DEBT_WATCHLIST_RANGE", "(not sp and net_debt_to_ebitda <= 5e0 and net_debt_to_ebitda > 3e0)", "W"),
    ("MISSING_SHARES_DILUTION_PROVIDER_LIMITATION", "shares_dilution_3y is null", "N"), ("HIGH_DILUTION", "shares_dilution_3y > 3e-1", "R"), ("DILUTION_WATCHLIST_RANGE", "(shares_dilution_3y <= 3e-1 and shares_dilution_3y > 1e-1)", "W"),
]
_S2 = f"(select *, {_status(_S2_RULES)} as stage2_status, {_codes(_S2_RULES)} as stage2_all_reasons from {_FB} b)"


def _stage2(spark: SparkSession, d: str) -> DataFrame:
    return stages.stage2(B.frame(spark, d, B.FUNDAMENTALS))


@query(f"select k, stage2_status, stage2_all_reasons from {_S2} s")
def stage2_status(spark: SparkSession, d: str) -> DataFrame:
    """C2, C3, C4."""
    return _stage2(spark, d).select("k", "stage2_status", "stage2_all_reasons")


@query(f"select k, gx as growth_exception, sp as special_case_flag from {_FB} b")
def stage2_growth_exception(spark: SparkSession, d: str) -> DataFrame:
    """C3, C4."""
    return B.frame(spark, d, B.FUNDAMENTALS).select("k", stages.growth_exception().alias("growth_exception"), stages.special_case().alias("special_case_flag"))


_OLD = [("MISSING_SHARES_DILUTION" if c.startswith("MISSING_SHARES") else c, w, "W" if c.startswith("MISSING_SHARES") else e) for c, w, e in _S2_RULES]


@query(f"select old_status || '->' || new_status as transition, count(*) as count from (select {_status(_OLD)} as old_status, {_status(_S2_RULES)} as new_status from {_FB} b) t group by 1")
def stage2_provider_policy(spark: SparkSession, d: str) -> DataFrame:
    """One reason replaced, rows reclassified from their reasons, transitions counted."""
    rows = pipelines.provider_policy(stages.stage2(B.frame(spark, d, B.FUNDAMENTALS), policies.STAGE2_EARLIER))
    return reports.group_counts(rows.withColumn("transition", F.concat_ws("->", "stage2_status", "adjusted_status")), "transition")


_up = lambda c, lo, hi: f"coalesce(greatest(0e0, least(10e0, ({c} - {lo}) / ({hi} - {lo}) * 10e0)), 0e0)"


def _scale(c: str, lo: float, hi: float, inverse: bool = False) -> str:
    up = f"case when {c} is null then 0e0 else greatest(0e0, least(10e0, ({c} - ({lo!r}e0)) / {hi - lo!r}e0 * 10e0)) end"
    return f"case when {c} is null then 0e0 else 10e0 - {up} end" if inverse else f"({up})"


def _present(*parts: tuple[str, str], default: str) -> str:
    n = " + ".join(f"case when {w} then 1 else 0 end" for w, _ in parts)
    t = " + ".join(f"case when {w} then {e} else 0e0 end" for w, e in parts)
    return f"case when {n} > 0 then ({t}) / ({n}) else {default} end"


_i = lambda c, lo, hi: "(" + _scale(c, lo, hi, True) + ")"
_fall = "abs(drawdown_from_52w_high)"
_BLOCKS = {
    "business_quality_score": f"({_scale('gross_margin', 0.2, 0.7)} + {_scale('operating_margin', 0.0, 0.35)} + {_scale('net_margin', 0.0, 0.3)} + {_scale('fcf_margin', 0.0, 0.3)}) / 4e0",
    "financial_health_score": f"({_i('net_debt_to_ebitda', 0.0, 5.0)} + {_scale('interest_coverage', 2.0, 25.0)} + {_scale('current_ratio', 0.8, 2.0)} + {_i('shares_dilution_3y', -0.05, 0.3)}) / 4e0",
    "growth_score": f"({_scale('revenue_growth_1y', -0.05, 0.25)} + {_scale('revenue_growth_3y', 0.0, 0.25)}) / 2e0",
    "valuation_score": _present(("fcf_yield is not null", _scale("fcf_yield", 0.02, 0.1)), ("coalesce(pe_ratio > 0, false)", _i("pe_ratio", 10.0, 45.0)), ("coalesce(ev_ebitda > 0, false)", _i("ev_ebitda", 6.0, 30.0)), ("coalesce(price_sales > 0, false)", _i("price_sales", 2.0, 20.0)), default="45e-1"),
    "risk_score": _present(("true", _scale("net_debt_to_ebitda", 0.0, 6.0)), ("true", _i("fcf_margin", -0.2, 0.2)), ("true", _scale("shares_dilution_3y", -0.05, 0.4)), ("true", _i("data_completeness_score", 40.0, 100.0)), (f"{_fall} is not null", _scale(_fall, 0.05, 0.6)), default="null"),
    "moat_proxy_score": f"({_scale('gross_margin', 0.25, 0.75)} + {_scale('operating_margin', 0.05, 0.35)} + {_scale('fcf_margin', 0.0, 0.3)} + {_scale('revenue_growth_3y', 0.02, 0.18)}) / 4e0",
    "momentum_score": _present(("price_change_6m is not null", _scale("price_change_6m", -0.2, 0.4)), ("relative_strength_6m is not null", _scale("relative_strength_6m", -0.2, 0.3)), (f"{_fall} is not null", _i(_fall, 0.05, 0.6)), default="5e0"),
    "liquidity_score": _scale("(coalesce(dollar_volume_90d, cast(null as double)))", 500000.0, 50000000.0),
    "data_quality_score": _scale("data_completeness_score", 50.0, 100.0),
}
_W3 = {"business_quality_score": "2e-1", "financial_health_score": "15e-2", "growth_score": "15e-2", "valuation_score": "15e-2", "moat_proxy_score": "15e-2", "momentum_score": "1e-1", "data_quality_score": "1e-1"}
_S3B = "(select *, " + ", ".join(f"{r2(f'greatest(0e0, least(10e0, {e}))')} as {c}" for c, e in _BLOCKS.items()) + f" from ({B.FUNDAMENTALS}) f)"
_S3F = f"(select *, {r2('greatest(0e0, least(100e0, (' + ' + '.join(f'{c} * {w}' for c, w in _W3.items()) + ') * 10e0 - risk_score * 5e-1))')} as final_stage3_score from {_S3B} b)"
_out = "risk_score > 85e-1 or data_quality_score < 35e-1 or final_stage3_score < 45"
_S3 = f"""(select *, case when {_out} then 'REJECTED' when risk_score > 75e-1 or data_quality_score < 5 or final_stage3_score < 60 then 'WATCHLIST' else 'PASSED' end as stage3_status,
case when risk_score > 85e-1 then 'HIGH_RISK_SCORE' when data_quality_score < 35e-1 then 'LOW_DATA_QUALITY' when final_stage3_score < 45 then 'LOW_FINAL_SCORE' when risk_score > 75e-1 then 'RISK_SCORE_WATCHLIST_RANGE' when data_quality_score < 5 then 'DATA_QUALITY_WATCHLIST_RANGE' when final_stage3_score < 60 then 'FINAL_SCORE_WATCHLIST_RANGE' else '' end as stage3_primary_reason,
case when {_out} then '{stages.DROPPED}' when data_quality_score < 5 then '{stages.THIN}' when risk_score > 75e-1 then '{stages.RISKY}' when final_stage3_score < 60 then '{stages.CONDITIONAL}'
when business_quality_score >= 7 and moat_proxy_score >= 7 and valuation_score < 5 then '{stages.DEMANDING}' when final_stage3_score >= 70 and business_quality_score >= 65e-1 then '{stages.STRONG}' else '{stages.CONDITIONAL}' end as stage3_category from {_S3F} f)"""


def _stage3(spark: SparkSession, d: str) -> DataFrame:
    return stages.stage3(B.frame(spark, d, B.FUNDAMENTALS))


@query(f"select k, {', '.join(_BLOCKS)}, final_stage3_score, stage3_status, stage3_category, stage3_primary_reason from {_S3} s")
def stage3_scores(spark: SparkSession, d: str) -> DataFrame:
    """K6, K7, C5."""
    return _stage3(spark, d).select("k", *_BLOCKS, "final_stage3_score", "stage3_status", "stage3_category", "stage3_primary_reason")


@query(f"select ticker, final_stage3_score, stage3_status from {_S3} s where stage3_status in ('PASSED', 'WATCHLIST') order by final_stage3_score desc, ticker limit 100")
def stage3_topn(spark: SparkSession, d: str) -> DataFrame:
    """T2 (the limit is the feature)."""
    return stages.top_candidates(_stage3(spark, d), 100).select("ticker", "final_stage3_score", "stage3_status")


@query(f"select ticker, final_stage3_score, stage3_primary_reason from {_S3} s where stage3_status <> 'PASSED' and stage3_primary_reason <> '' order by final_stage3_score desc, ticker limit 100")
def stage3_recoverable(spark: SparkSession, d: str) -> DataFrame:
    """T3 (the limit is the feature)."""
    return stages.top_recoverable(_stage3(spark, d)).select("ticker", "final_stage3_score", "stage3_primary_reason")


@query(f"""select 'stage1' as stage, count(*) as companies, count(*) filter (stage1_status = 'PASSED') as passed, {r2("count(*) filter (stage1_status = 'PASSED') * 1e0 / count(*) * 100e0")} as pass_rate_percent from {_S1} a
union all select 'stage2', count(*), count(*) filter (stage2_status = 'PASSED'), {r2("count(*) filter (stage2_status = 'PASSED') * 1e0 / count(*) * 100e0")} from {_S2} b
union all select 'stage3', count(*), count(*) filter (stage3_status = 'PASSED'), {r2("count(*) filter (stage3_status = 'PASSED') * 1e0 / count(*) * 100e0")} from {_S3} c""")
def funnel_table(spark: SparkSession, d: str) -> DataFrame:
    """The stages side by side, each over its whole table."""
    return reports.funnel({"stage1": _stage1(spark, d), "stage2": _stage2(spark, d), "stage3": _stage3(spark, d)})


@query(f"select k, stage1_status, stage2_status, case when stage2_status = 'PASSED' then stage3_status end as stage3_status from (select k, stage1_status from {_S1} a where trim(ticker) <> '') x left join (select k, stage2_status from {_S2} b) y using (k) left join (select k, stage3_status from {_S3} c) z using (k) where stage1_status = 'PASSED'")
def funnel_chain(spark: SparkSession, d: str) -> DataFrame:
    """What passes Stage 1, joined with its fundamentals, through Stage 2 and, if it passes that, Stage 3; the binding is made once."""
    companies = settled(B.frame(spark, d, B.UNIVERSE))
    fundamentals = spark.sql(B.FUNDAMENTALS.replace(B.UNIVERSE, "select * from {base}"), base=companies)
    return pipelines.funnel_rows(companies, fundamentals).select("k", "stage1_status", "stage2_status", "stage3_status")


# ---------------------------------------------------------------- prices, quality, filters, priority

_mean = lambda c, n, size: f"cast(sum(cast({c} as decimal(28,8))) filter ({n} <= {size}) as double) / nullif(count(*) filter ({n} <= {size}), 0)"
_BARS = f"(select *, case when close is not null then count(close) over w end as nc, case when volume is not null then count(volume) over w end as nv from ({B.PRICES}) p window w as (partition by ticker order by date desc, close nulls first, volume nulls first rows unbounded preceding))"
_MM = f"""(select ticker, count(close) as bars, max(close) filter (nc = 1) as price, max(close) filter (nc = 2) as previous_close, max(close) filter (nc = 6) as c5, max(close) filter (nc = 21) as c20, max(volume) filter (nv = 1) as volume,
{_mean('volume', 'nv', 50)} as avg_volume_50d, case when count(close) >= 20 then {_mean('close', 'nc', 20)} end as ma20, case when count(close) >= 50 then {_mean('close', 'nc', 50)} end as ma50, max(close) as high_52w, min(close) as low_52w from {_BARS} b group by ticker)"""
_chg = lambda c: f"case when {c} <> 0 then price / {c} - 1e0 end"
_MS = f"""(select ticker, bars, price, previous_close, volume, avg_volume_50d, case when avg_volume_50d <> 0 then volume / avg_volume_50d end as relative_volume, {_chg('previous_close')} as change_1d, {_chg('c5')} as change_5d, {_chg('c20')} as change_20d,
ma20, ma50, price > ma20 as above_ma20, price > ma50 as above_ma50, high_52w, low_52w, {_chg('high_52w')} as distance_to_52w_high, {_chg('low_52w')} as distance_to_52w_low from {_MM} m)"""


@query(f"select * from {_MS} s")
def market_metrics(spark: SparkSession, d: str) -> DataFrame:
    """N1, N2."""
    return market.market_metrics(B.frame(spark, d, B.PRICES))


@query(f"""select ticker, date, close, case when count(close) over w20 = 20 then cast(sum(cast(close as decimal(28,8))) over w20 as double) / 20 end as ma20, case when count(close) over w50 = 50 then cast(sum(cast(close as decimal(28,8))) over w50 as double) / 50 end as ma50,
case when lag(close, 1) over w <> 0 then close / lag(close, 1) over w - 1e0 end as change_1d, case when lag(close, 5) over w <> 0 then close / lag(close, 5) over w - 1e0 end as change_5d
from ({B.PRICES}) p where close is not null window w as (partition by ticker order by date), w20 as (partition by ticker order by date rows 19 preceding), w50 as (partition by ticker order by date rows 49 preceding)""")
def rolling_ma(spark: SparkSession, d: str) -> DataFrame:
    """N2 for every date."""
    return market.rolling_metrics(B.frame(spark, d, B.PRICES))


_COMPANY = "select 'U' || cast(c_custkey as string) as ticker, case when c_custkey % 9 = 0 then '' else c_name end as company_name, c_mktsegment as sector, case when c_custkey % 4 = 0 then null else c_mktsegment end as industry, 'NYSE' as exchange, case when c_custkey % 6 = 0 then null else 'USD' end as currency, case when c_custkey % 8 = 0 then null else c_acctbal * 3e7 end as market_cap from {customer}"
_SNAP = f"(select c.*, m.* exclude (ticker) from ({_COMPANY}) c left join {_MS} m on m.ticker = c.ticker)"
_blank = lambda c: f"coalesce(trim(cast({c} as varchar)), '') = ''"
_DQ = "greatest(0, least(100, 100" + "".join(f" - case when {_blank(c)} then {w} else 0 end" for fs, w in ((market.CRITICAL, 10), (market.IMPORTANT, 4), (market.CONTEXT, 2)) for c in fs) + "".join(f" - case when {c} {o} 0 then {w} else 0 end" for c, o, w in market.INVALID) + "))"
_ISS = "concat_ws(';', " + ", ".join([f"case when {_blank(c)} then 'missing_{k}_field:{c}' end" for k, fs in (("critical", market.CRITICAL), ("important", market.IMPORTANT)) for c in fs] + [f"case when {c} {o} 0 then 'invalid_{c}' end" for c, o, _ in market.INVALID]) + ")"
_Q = f"(select *, {_DQ} as data_quality_score, {_ISS} as data_quality_issues from {_SNAP} s)"
_QL = f"(select *, case when data_quality_score >= 85 then 'high' when data_quality_score >= 60 then 'medium' else 'low' end as data_quality_label from {_Q} q)"
_P = f"(select *, coalesce(price < 2, true) as excluded_by_price, coalesce(market_cap < 100000000, true) as excluded_by_market_cap, coalesce(avg_volume_50d < 300000, true) as excluded_by_avg_volume_50d, coalesce(data_quality_score < 60, true) as excluded_by_data_quality from {_QL} l)"


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return market.data_quality(B.frame(spark, d, _COMPANY).join(market.market_metrics(B.frame(spark, d, B.PRICES)), "ticker", "left"))


@query(f"select ticker, data_quality_score, data_quality_label, data_quality_issues from {_QL} l")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """K4, K5, C26."""
    return _quality(spark, d).select("ticker", "data_quality_score", "data_quality_label", "data_quality_issues")


@query(f"select ticker, 'market_data' as source, issue, case when issue like '%critical%' or issue like '%invalid%' then 'high' else 'medium' end as severity from (select ticker, unnest(string_split(data_quality_issues, ';')) as issue from {_Q} q where data_quality_issues <> '') x")
def quality_issues_exploded(spark: SparkSession, d: str) -> DataFrame:
    """A39."""
    return market.quality_errors(_quality(spark, d))


@query(f"select count(*) as total_rows, count(*) filter (data_quality_label = 'high') as high_quality_rows, count(*) filter (data_quality_label = 'medium') as medium_quality_rows, count(*) filter (data_quality_label = 'low') as low_quality_rows, avg(data_quality_score) as avg_data_quality_score, count(*) filter (data_quality_issues <> '') as rows_with_issues from {_QL} l")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return market.quality_summary(_quality(spark, d))


_PASS = "not (excluded_by_price or excluded_by_market_cap or excluded_by_avg_volume_50d or excluded_by_data_quality)"


@query(f"select ticker, excluded_by_price, excluded_by_market_cap, excluded_by_avg_volume_50d, excluded_by_data_quality, {_PASS} as passes_basic_filters, concat_ws(';', case when excluded_by_price then 'price_below_min_or_missing:2' end, case when excluded_by_market_cap then 'market_cap_below_min_or_missing:100000000' end, case when excluded_by_avg_volume_50d then 'avg_volume_50d_below_min_or_missing:300000' end, case when excluded_by_data_quality then 'data_quality_below_min_or_missing:60' end) as filter_reasons from {_P} p")
def basic_filters(spark: SparkSession, d: str) -> DataFrame:
    """P12."""
    return market.basic_filters(_quality(spark, d)).select("ticker", "excluded_by_price", "excluded_by_market_cap", "excluded_by_avg_volume_50d", "excluded_by_data_quality", "passes_basic_filters", "filter_reasons")


_clamp = lambda e: f"greatest(0e0, least(100e0, {e}))"
_PS = f"""(select *, {case(('relative_volume is null', '0e0'), ('relative_volume >= 25e-1', '100e0'), ('relative_volume >= 15e-1', '80e0'), ('relative_volume >= 1e0', '60e0'), ('relative_volume >= 8e-1', '40e0'), default='20e0')} as score_volume,
{r2(_clamp("50e0 + coalesce(change_1d * 250e0, 0e0) + coalesce(change_5d * 180e0, 0e0) + coalesce(change_20d * 90e0, 0e0) + case when change_1d > 15e-2 then -15e0 else 0e0 end + case when change_5d > 35e-2 then -15e0 else 0e0 end + case when change_20d < -25e-2 then -15e0 else 0e0 end"))} as score_momentum,
{r2(_clamp(case(('avg_volume_50d is null', '0e0'), ('avg_volume_50d >= 1e7', '100e0'), ('avg_volume_50d >= 3e6', '85e0'), ('avg_volume_50d >= 1e6', '70e0'), ('avg_volume_50d >= 3e5', '55e0'), default='20e0') + ' * 55e-2 + ' + case(('market_cap is null', '0e0'), ('market_cap >= 1e11', '100e0'), ('market_cap >= 1e10', '85e0'), ('market_cap >= 1e9', '70e0'), ('market_cap >= 1e8', '50e0'), default='20e0') + ' * 45e-2'))} as score_liquidity,
{r2(_clamp("40e0 + case when above_ma20 then 20e0 else 0e0 end + case when above_ma50 then 20e0 else 0e0 end + case when distance_to_52w_high >= -5e-2 then 20e0 when distance_to_52w_high >= -15e-2 then 10e0 when distance_to_52w_high < -4e-1 then -10e0 else 0e0 end"))} as score_context,
{r2(_clamp("25e0 + case when abs(change_1d) > 8e-2 then 20e0 else 0e0 end + case when abs(change_5d) > 18e-2 then 20e0 else 0e0 end + case when relative_volume > 3 then 20e0 else 0e0 end + case when relative_volume < 5e-1 then 10e0 else 0e0 end"))} as score_risk,
{r2(_clamp(f"data_quality_score - case when {_PASS} then 0e0 else 30e0 end"))} as score_confidence, {_PASS} as passes from {_P} p)"""
_RAW = "(score_volume * 25e-2 + score_momentum * 25e-2 + score_liquidity * 2e-1 + score_context * 15e-2 + 50e0 * 1e-1 + 50e0 * 5e-2)"
_PEN = "(case when passes then 0e0 else 35e0 end + case when score_confidence < 60 then 20e0 else 0e0 end + case when score_risk > 70 then 10e0 else 0e0 end)"
_PRI = f"(select *, {r2(_RAW)} as score_raw, {_PEN} as penalty_total, {r2(_clamp(f'{_RAW} - {_PEN}'))} as score_adjusted, {_clamp(_clamp(f'{_RAW} - {_PEN}') + ' * 75e-2 + score_confidence * 25e-2')} as pr from {_PS} s)"
_CAT = f"(select *, {r2('pr')} as score_priority, case when not passes then 'excluded' when score_confidence < 60 then 'low_confidence' when score_risk >= 85 then 'high_risk_review' when pr >= 80 then 'high_priority_research' when pr >= 65 then 'medium_priority_research' when pr >= 50 then 'watchlist' else 'low_priority' end as category_final from {_PRI} p)"
_PCOLS = ["ticker", "score_volume", "score_momentum", "score_liquidity", "score_context", "score_risk", "score_confidence", "score_raw", "penalty_total", "score_adjusted", "score_priority", "category_final"]


@query(f"select {', '.join(_PCOLS)} from {_CAT} c")
def priority_score(spark: SparkSession, d: str) -> DataFrame:
    """The quant pipeline's scores."""
    return pipelines.quant(B.frame(spark, d, _COMPANY), B.frame(spark, d, B.PRICES)).select(*_PCOLS)


# ---------------------------------------------------------------- local chain

_PX = "(case when change_1d is null then 0 else 1 end + case when change_5d is null then 0 else 1 end + case when change_20d is null then 0 else 1 end)"
_AVG = f"(case when {_PX} > 0 then (coalesce(change_1d * 100e0, 0e0) + coalesce(change_5d * 100e0, 0e0) + coalesce(change_20d * 100e0, 0e0)) / {_PX} end)"
_EXT = "(coalesce(abs(change_1d * 100e0) > 50, false) or coalesce(abs(change_5d * 100e0) > 50, false) or coalesce(abs(change_20d * 100e0) > 50, false))"
_nz = lambda c: f"coalesce({c} <> 0, false)"
_if = lambda w, a, b="0e0": f"case when {w} then {a} else {b} end"
_LS = f"""(select *, {r2('100e0 * (' + ' + '.join(_if(f"coalesce(trim({c}), '') <> ''", '1e0') for c in ('ticker', 'company_name', 'exchange', 'country', 'sector', 'industry')) + ') / 6e0')} as metadata_component_score,
{r2(_clamp(' + '.join([_if(_nz('regular_market_price'), '25e0'), _if(_nz('market_cap'), '25e0'), _if(_nz('volume'), '20e0'), _if(_nz('relative_volume'), '10e0'), _if('change_1d is not null', '5e0'), _if('change_5d is not null', '75e-1'), _if('change_20d is not null', '75e-1')])))} as market_data_component_score,
{r2(_clamp('50e0 + ' + case(('volume is null', '-25e0'), ('volume >= 1e6', '25e0'), ('volume >= 1e5', '15e0'), default='-10e0') + ' + ' + case(('market_cap is null', '-15e0'), ('market_cap >= 1e10', '25e0'), ('market_cap >= 1e9', '15e0'), default='0e0')))} as liquidity_component_score,
case when {_AVG} is null then 50e0 else {r2(_clamp(f"60e0 + {case((f'{_AVG} >= -10 and {_AVG} <= 15', '20e0'), (f'{_AVG} >= -25 and {_AVG} <= 35', '5e0'), default='-20e0')} + {_if(_EXT, '-25e0')}"))} end as momentum_component_score,
{r2(_clamp("70e0 + case stage3_status when 'MARKET_DATA_SCORE_MANUAL' then 20e0 when 'MARKET_DATA_SCORE_YFINANCE' then 15e0 else -25e0 end + " + _if("market_data_provider = 'manual_market_data.csv'", '5e0') + ' + ' + _if("error <> ''", '-20e0')))} as data_quality_component_score,
{r2("greatest(0e0, least(60e0, " + ' + '.join([_if(_nz('regular_market_price'), '0e0', '12e0'), _if('market_cap is null', '8e0'), _if('volume is null', '8e0'), *[_if(f'abs({c} * 100e0) > 50', '8e0') for c in ('change_1d', 'change_5d', 'change_20d')], _if("stage3_status = 'METADATA_SCORE_FALLBACK'", '15e0'), _if("error <> ''", '10e0')]) + "))")} as penalty_score from ({B.LOCAL}) l)"""
_LT = f"(select *, {r2(_clamp('metadata_component_score * 15e-2 + market_data_component_score * 25e-2 + liquidity_component_score * 2e-1 + momentum_component_score * 15e-2 + data_quality_component_score * 25e-2 - penalty_score * 25e-2'))} as local_score_v0 from {_LS} s)"
_cat4 = lambda c, p: f"case when {c} >= 85 then '{p}_high' when {c} >= 70 then '{p}_medium' when {c} >= 55 then '{p}_watch' else '{p}_low' end"
_LCOLS = ["input_ordinal", "metadata_component_score", "market_data_component_score", "liquidity_component_score", "momentum_component_score", "data_quality_component_score", "penalty_score", "local_score_v0"]


@query(f"select {', '.join(_LCOLS)}, {_cat4('local_score_v0', 'local_score')} as local_score_category from {_LT} t")
def local_score(spark: SparkSession, d: str) -> DataFrame:
    """K8."""
    return scoring.local_score(B.frame(spark, d, B.LOCAL)).select(*_LCOLS, "local_score_category")


_pos = [("datos de mercado completos", "market_data_component_score >= 85"), ("liquidez/tamaño razonables", "liquidity_component_score >= 80"), ("momentum sin extremos", "momentum_component_score >= 75"), ("buena calidad/fuente de datos", "data_quality_component_score >= 85")]
_neg = [("datos de mercado incompletos", "market_data_component_score < 60"), ("liquidez o tamaño débiles", "liquidity_component_score < 55"), ("momentum extremo o débil", "momentum_component_score < 50"), ("calidad de datos limitada", "data_quality_component_score < 60"), ("penalizaciones relevantes", "penalty_score >= 20"), ("sin datos de mercado usable", "stage3_status = 'METADATA_SCORE_FALLBACK'"), ("error de proveedor", "error <> ''")]
_mis = [("precio", "regular_market_price is null"), ("market cap", "market_cap is null"), ("volumen", "volume is null"), ("volumen relativo", "relative_volume is null"), ("1D", "change_1d is null"), ("5D", "change_5d is null"), ("20D", "change_20d is null")]
_say = lambda xs: "concat_ws(' | ', " + ", ".join(f"case when {w} then '{t}' end" for t, w in xs) + ")"


@query(f"select input_ordinal, coalesce(nullif({_say(_pos)}, ''), 'sin fortalezas destacadas') as positive_factors, coalesce(nullif({_say(_neg)}, ''), 'sin alertas fuertes') as negative_factors, {_say(_mis)} as missing_data_flags from {_LT} t")
def explain_factors(spark: SparkSession, d: str) -> DataFrame:
    """K21."""
    return scoring.explain(scoring.local_score(B.frame(spark, d, B.LOCAL))).select("input_ordinal", "positive_factors", "negative_factors", "missing_data_flags")


_lad = lambda c, ladder, least, missing: "case when " + f"{c} is null then {missing}e0 " + " ".join(f"when {c} >= {a} then {v}e0" for a, v in ladder) + f" else {least}e0 end"
_g = lambda c: f"coalesce({c}, 0e0)"
_GRAN = r2(_clamp(" + ".join([
    "case when " + " when ".join(f"{_g('revenue')} >= {a} then {v}e0" for a, v in (("1e11", 100), ("5e10", 90), ("25e9", 80), ("1e10", 70), ("5e9", 60))) + " else 45e0 end * 15e-2", f"{_clamp('50e0 + ' + _g('revenue_growth_yoy') + ' * 4e0')} * 2e-1",
    f"{_clamp(_g('gross_margin') + ' / 65e0 * 100e0')} * 15e-2", f"{_clamp(_g('operating_margin') + ' / 40e0 * 100e0')} * 15e-2", f"{_clamp(_g('net_margin') + ' / 35e0 * 100e0')} * 1e-1",
    f"case when {_g('free_cash_flow')} >= 5e10 then 100e0 when {_g('free_cash_flow')} >= 2e10 then 90e0 when {_g('free_cash_flow')} >= 1e10 then 80e0 when {_g('free_cash_flow')} >= 5e9 then 70e0 when {_g('free_cash_flow')} > 0 then 55e0 else 30e0 end * 15e-2",
    f"case when {_g('total_debt')} <= 0 then 100e0 when {_g('total_cash')} / total_debt >= 15e-1 then 100e0 when {_g('total_cash')} / total_debt >= 1 then 90e0 when {_g('total_cash')} / total_debt >= 75e-2 then 80e0 when {_g('total_cash')} / total_debt >= 5e-1 then 70e0 else 55e0 end * 1e-1",
])))
_FUND = r2(_clamp(" + ".join([
    "50e0", "case when revenue is null then -12e0 when revenue >= 5e10 then 10e0 when revenue >= 5e9 then 6e0 when revenue > 0 then 2e0 else -10e0 end",
    _lad("revenue_growth_yoy", [(10, 10), (3, 6), (0, 2)], -8, -6), _lad("gross_margin", [(60, 10), (40, 7), (20, 2)], -6, -5), _lad("operating_margin", [(30, 10), (15, 6), (0, 1)], -10, -5), _lad("net_margin", [(20, 7), (8, 4), (0, 0)], -8, -3),
    "case when free_cash_flow is null then -7e0 when free_cash_flow > 0 then 10e0 else -10e0 end",
    "case when total_cash is null or total_debt is null then -3e0 when total_debt <= 0 and total_cash > 0 then 6e0 when total_cash >= total_debt then 6e0 when total_debt > total_cash * 3e0 then -8e0 else 1e0 end",
])))
_MOM = f"(case when {_PX} > 0 then (coalesce(change_1d, 0e0) + coalesce(change_5d, 0e0) + coalesce(change_20d, 0e0)) / {_PX} end)"
_CJ = f"(select l.*, f.ticker is not null as has, f.* exclude (ticker, input_ordinal, n) from {_LT} l left join (select * from (select *, row_number() over (partition by ticker order by input_ordinal desc) as n from ({B.MANUAL_FUNDAMENTALS}) m) x where n = 1) f on f.ticker = l.ticker)"
_MD = f"(50e0 + -12e0 + case when market_cap > 1e9 then 12e0 when market_cap is null then -8e0 else -4e0 end + case when volume > 500000 then 10e0 when volume is null then -6e0 else -2e0 end + {_if('relative_volume >= 3e-1 and relative_volume <= 3e0', '5e0')} + {case((f'{_MOM} is null', '-4e0'), (f'{_MOM} >= -5 and {_MOM} <= 15', '8e0'), (f'{_MOM} < -10 or {_MOM} > 30', '-8e0'), default='2e0')})"
_QU = "(60e0 + case when coalesce(trim(sector), '') <> '' then 12e0 else -6e0 end + case when coalesce(trim(industry), '') <> '' then 12e0 else -6e0 end + case when coalesce(trim(exchange), '') <> '' then 8e0 else -4e0 end)"
_CC = f"""(select *, {r2(_clamp(f'{_QU} * 45e-2 + local_score_v0 * 55e-2'))} as metadata_score_component, {r2(_clamp(f'{_MD} * 65e-2 + local_score_v0 * 35e-2'))} as market_data_score_component,
case when has then {_FUND} else 35e0 end as fundamentals_score_component, case when has then {_GRAN} else 0e0 end as fundamentals_granular_score from {_CJ} j)"""
_CS = f"(select *, {r2(_clamp('metadata_score_component * 2e-1 + market_data_score_component * 35e-2 + fundamentals_score_component * 45e-2'))} as combined_score_v1 from {_CC} c)"


def _combined(spark: SparkSession, d: str) -> DataFrame:
    return scoring.combined_score(scoring.local_score(B.frame(spark, d, B.LOCAL)), B.frame(spark, d, B.MANUAL_FUNDAMENTALS))


@query(f"select input_ordinal, metadata_score_component, market_data_score_component, fundamentals_score_component, combined_score_v1, {_cat4('combined_score_v1', 'combined_score')} as combined_category from {_CS} s")
def combined_score(spark: SparkSession, d: str) -> DataFrame:
    """J6, K9."""
    return _combined(spark, d).select("input_ordinal", "metadata_score_component", "market_data_score_component", "fundamentals_score_component", "combined_score_v1", "combined_category")


@query(f"select input_ordinal, fundamentals_granular_score from {_CS} s")
def granular_score(spark: SparkSession, d: str) -> DataFrame:
    """K10."""
    return _combined(spark, d).select("input_ordinal", "fundamentals_granular_score")


@query(f"select input_ordinal, case when count(*) over (partition by combined_score_v1, metadata_score_component, market_data_score_component, fundamentals_score_component) > 1 then 'EXACT_COMPONENT_TIE' else 'NO_TIE' end as tie_status from {_CS} s")
def tie_status(spark: SparkSession, d: str) -> DataFrame:
    """N10."""
    return _combined(spark, d).select("input_ordinal", "tie_status")


_SW = "(select * from (values " + ", ".join(f"('{k}', {a!r}e0, {b!r}e0, {c!r}e0)" for k, (a, b, c) in policies.SENSITIVITY.items()) + ") w(scenario, wm, wd, wf))"
_SENS = f"(select ticker, scenario, {r2('metadata_score_component * wm + market_data_score_component * wd + fundamentals_score_component * wf')} as scenario_score from {_CS} s cross join {_SW} w)"


@query(f"select * from {_SENS} s")
def weight_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """K20."""
    return scoring.weight_sensitivity(_combined(spark, d))


@query(f"select *, rank() over (partition by scenario order by scenario_score desc) as scenario_rank from {_SENS} s")
def scenario_rank(spark: SparkSession, d: str) -> DataFrame:
    """N12."""
    return scoring.scenario_rank(scoring.weight_sensitivity(_combined(spark, d)))


_UNI8 = "select c_custkey + 1 as input_ordinal, 'T' || cast(c_custkey % 1200 as string) as ticker, c_name as name, 'NYSE' as exchange, 'USA' as country, c_mktsegment as sector, '' as industry from {customer}"
_MAN8 = "select s_suppkey as input_ordinal, ' t' || cast(s_suppkey * 3 % 250 as string) as ticker, case when s_suppkey % 7 = 0 then 0e0 else s_acctbal end as price, s_acctbal * 1e6 as market_cap, case when s_suppkey % 5 = 0 then null else s_suppkey * 1e4 end as volume, s_suppkey * 4e3 as average_volume, (s_suppkey % 30 - 10) * 1e0 as change_1d_pct, 12e-1 as change_5d_pct, (s_suppkey % 90 - 40) * 1e0 as change_20d_pct from {supplier}"
_YF8 = "select p_partkey as input_ordinal, 'T' || cast(p_partkey as string) as ticker, case when p_partkey % 4 = 0 then null else p_retailprice end as regular_market_price, p_retailprice * 1e6 as market_cap, p_size * 1e4 as volume, p_size * 8e3 as average_volume, 125e-2 as relative_volume, 1e-2 as change_1d, cast(null as double) as change_5d, (p_partkey % 100 - 40) / 100e0 as change_20d from {part}"
_first = lambda sql: f"(select * from (select *, row_number() over (partition by upper(trim(ticker)) order by input_ordinal) as n from ({sql}) a) b where n = 1)"
_C20 = "(case when m.ticker is not null then floor(m.change_20d_pct / 100e0 * 1e6 + 5e-1) / 1e6 else y.change_20d end)"
_pick = lambda a, b: f"(case when m.ticker is not null then {a} else {b} end)"
_PR, _MC, _VO = _pick("nullif(m.price, 0)", "y.regular_market_price"), _pick("m.market_cap", "y.market_cap"), _pick("m.volume", "y.volume")


@query(f"""select u.ticker, case when m.ticker is not null then 'MARKET_DATA_SCORE_MANUAL' when y.ticker is not null then 'MARKET_DATA_SCORE_YFINANCE' else 'METADATA_SCORE_FALLBACK' end as stage3_status, {_PR} as regular_market_price, {_VO} as volume,
{r2(_clamp(f"70e0 + case when {_PR} <> 0 then 8e0 else -10e0 end + case when {_MC} > 1e9 then 7e0 when {_MC} <> 0 then 3e0 else -4e0 end + case when {_VO} > 100000 then 5e0 when {_VO} <> 0 then 2e0 else -3e0 end + case when {_C20} is null then 0e0 when {_C20} * 100e0 >= -25 and {_C20} * 100e0 <= 40 then 3e0 else -4e0 end + greatest(0e0, 5e0 - u.input_ordinal * 1e-1)"))} as fallback_score
from {_first(_UNI8)} u left join {_first(_MAN8)} m on upper(trim(m.ticker)) = u.ticker left join (select * from {_first(_YF8)} q where regular_market_price is not null) y on y.ticker = u.ticker""")
def provider_fallback(spark: SparkSession, d: str) -> DataFrame:
    """J7, K13."""
    out = scoring.provider_fallback(B.frame(spark, d, _UNI8), B.frame(spark, d, _MAN8), B.frame(spark, d, _YF8))
    return out.select("ticker", "stage3_status", "regular_market_price", "volume", "fallback_score")


# ---------------------------------------------------------------- listing universe

_KIND = "case " + " ".join("when " + " or ".join(f"n like '%{w}%'" for w in ws) + f" then '{t}'" for t, _, _, ws in universe.BY_NAME) + " when length(symbol) >= 5 and (symbol like '%W' or symbol like '%WS') then 'WARRANT' when length(symbol) >= 5 and symbol like '%R' then 'RIGHT' when length(symbol) >= 5 and symbol like '%U' then 'UNIT' when symbol like '%-P%' or symbol like '%.P%' then 'PREFERRED' else 'COMMON_STOCK' end"
_IC = f"(select k, symbol, {_KIND} as instrument_type from (select *, lower(name) as n from ({B.NAMES}) a) b)"


@query(f"select k, instrument_type, case when instrument_type in ('COMMON_STOCK', 'REIT', 'ADR') then 'IN_SCOPE' else 'OUT_OF_SCOPE' end as instrument_scope, case when instrument_type not in ('COMMON_STOCK', 'REIT', 'ADR') then 'OUT_OF_SCOPE_' || instrument_type end as reason_code from {_IC} c")
def instrument_class(spark: SparkSession, d: str) -> DataFrame:
    """C7, C9, C18."""
    return universe.instrument_class(B.frame(spark, d, B.NAMES)).select("k", "instrument_type", "instrument_scope", "reason_code")


_FL = "case when upper(test_flag) = 'Y' then 'TEST_ISSUE' when upper(etf_flag) = 'Y' then 'ETF' " + " ".join(f"when u like '%{w}%' then '{t}'" for t, _, _, w in universe.BY_FLAG) + " else 'COMMON_STOCK' end"


@query(f"select k, {_FL} as instrument_type from (select *, upper(name) as u from ({B.NAMES}) a) b")
def instrument_flags(spark: SparkSession, d: str) -> DataFrame:
    """C8."""
    df = B.frame(spark, d, B.NAMES)
    return df.select("k", universe.instrument_flags(F.col("name"), F.col("etf_flag"), F.col("test_flag"))["instrument_type"].alias("instrument_type"))


@query(f"select exchange, ticker, isin, company_name, source_provider, input_ordinal from ({B.CANDIDATES}) c where not exists (select 1 from ({B.BASELINE}) b where b.exchange = c.exchange and b.ticker = c.ticker)")
def net_new_anti(spark: SparkSession, d: str) -> DataFrame:
    """J12."""
    return universe.net_new(B.frame(spark, d, B.CANDIDATES), B.frame(spark, d, B.BASELINE), ["exchange", "ticker"])


@query(f"select exchange, ticker, isin, company_name, source_provider, input_ordinal from ({B.CANDIDATES}) c where exists (select 1 from ({B.BASELINE}) b where b.exchange = c.exchange and b.ticker = c.ticker)")
def overlap_semi(spark: SparkSession, d: str) -> DataFrame:
    """J12, U4."""
    return universe.overlap(B.frame(spark, d, B.CANDIDATES), B.frame(spark, d, B.BASELINE), ["exchange", "ticker"])


@query(f"select input_ordinal, case when isin <> '' and isin in (select isin from ({B.BASELINE}) b) then 'already_in_baseline_by_isin' when ticker in (select ticker from ({B.BASELINE}) b where exchange in ('N1', 'N2')) then 'already_in_baseline_by_exchange_ticker' else 'diagnostic_not_found_in_baseline' end as baseline_status from ({B.CANDIDATES}) c")
def labelled_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """By ISIN, then by ticker under two spellings of an exchange."""
    return universe.baseline_status(B.frame(spark, d, B.CANDIDATES), B.frame(spark, d, B.BASELINE), spellings=("N1", "N2")).select("input_ordinal", "baseline_status")


@query(f"select exchange, ticker, isin, company_name, source_provider, input_ordinal from (select *, row_number() over (partition by ticker order by input_ordinal) as n from ({B.CANDIDATES}) c) x where n = 1")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """R1."""
    return universe.dedupe_first(B.frame(spark, d, B.CANDIDATES), ["ticker"])


@query(f"select input_ordinal, n as duplicate_number, case when n = 1 then 'KEPT' else 'DUPLICATE' end as decision from (select *, row_number() over (partition by exchange, ticker order by input_ordinal) as n from ({B.CANDIDATES}) c) x")
def dedupe_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """R3."""
    return universe.dedupe_labelled(B.frame(spark, d, B.CANDIDATES), ["exchange", "ticker"]).select("input_ordinal", "duplicate_number", "decision")


_MA = f"(select c.*, case when b.ticker is not null then 'ALREADY_IN_BASELINE' when n > 1 then 'DUPLICATE_IN_SOURCE' else 'ADDED' end as merge_action from (select *, row_number() over (partition by exchange, ticker order by input_ordinal) as n from ({B.CANDIDATES}) x) c left join (select distinct exchange, ticker from ({B.BASELINE}) y) b on b.exchange = c.exchange and b.ticker = c.ticker)"


@query(f"select input_ordinal, merge_action from {_MA} m")
def merge_audit(spark: SparkSession, d: str) -> DataFrame:
    """U6."""
    return universe.merge_audit(B.frame(spark, d, B.BASELINE), B.frame(spark, d, B.CANDIDATES), ["exchange", "ticker"]).select("input_ordinal", "merge_action")


@query(f"select exchange, ticker, isin, company_name, '' as source_provider from ({B.BASELINE}) b union all select exchange, ticker, isin, company_name, source_provider from {_MA} m where merge_action = 'ADDED'")
def union_widened(spark: SparkSession, d: str) -> DataFrame:
    """U2, X9."""
    return pipelines.add_provider(B.frame(spark, d, B.BASELINE).drop("input_ordinal"), B.frame(spark, d, B.CANDIDATES), ["exchange", "ticker"])[0]


@query(f"select exchange, ticker, count(*) as count from ({B.CANDIDATES}) c group by 1, 2 having count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    return reports.duplicate_keys(B.frame(spark, d, B.CANDIDATES), "exchange", "ticker")


@query(f"select coalesce(nullif(trim(source_provider), ''), 'UNKNOWN') as source_provider, count(*) as count from ({B.CANDIDATES}) c group by 1")
def provider_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """A20."""
    return reports.provider_breakdown(B.frame(spark, d, B.CANDIDATES))


@query(f"select coalesce(a.exchange, e.exchange) as exchange, coalesce(a.count, 0) as actual, coalesce(e.count, 0) as expected, case when e.count is null then 'UNEXPECTED_PROVIDER' when a.count = e.count then 'OK' else 'MISMATCH' end as status from (select exchange, count(*) as count from ({B.CANDIDATES}) c group by 1) a full outer join (select exchange, count(*) as count from ({B.BASELINE}) b group by 1) e on a.exchange = e.exchange")
def expected_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    """A22."""
    count = lambda sql: reports.group_counts(B.frame(spark, d, sql), "exchange")
    return reports.expected_vs_actual(count(B.CANDIDATES), count(B.BASELINE), "exchange")


@query(f"""with c as ({B.CANDIDATES}), k as (select count(*) as d from (select 1 from c group by exchange, ticker having count(*) > 1) x)
select 'rows_present' as check_name, 'critical' as severity, count(*) as observed, count(*) > 0 as passed from c union all select 'no_duplicate_keys', 'critical', d, d = 0 from k
union all select 'no_blank_exchange', 'critical', count(*) filter (exchange = ''), count(*) filter (exchange = '') = 0 from c union all select 'no_blank_ticker', 'critical', count(*) filter (ticker = ''), count(*) filter (ticker = '') = 0 from c
union all select 'no_blank_isin', 'warning', count(*) filter (isin = ''), count(*) filter (isin = '') = 0 from c""")
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    """A23."""
    return reports.integrity_checks(B.frame(spark, d, B.CANDIDATES), ("exchange", "ticker"), ["exchange", "ticker", "isin"])


@query(f"""with c as (select exchange, ticker, count(*) as n from ({B.CANDIDATES}) x group by 1, 2), b as (select distinct exchange, ticker from ({B.BASELINE}) y),
m as (select cast(sum(n) as bigint) as candidate_rows, count(*) as candidate_keys, count(b.ticker) as overlap_keys, (select count(*) from b) as baseline_keys from c left join b on b.exchange = c.exchange and b.ticker = c.ticker)
select *, candidate_keys - overlap_keys as net_new_keys, {r2('(candidate_keys - overlap_keys) * 1e0 / baseline_keys * 100e0')} as gain_percent from m""")
def coverage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A24, A38."""
    return reports.coverage_metrics(B.frame(spark, d, B.CANDIDATES), B.frame(spark, d, B.BASELINE), ["exchange", "ticker"])


_COV = ("company_name", "industry", "price", "market_cap", "is_active")


@query(" union all ".join(f"select '{c}' as column_name, count(*) - count(*) filter ({_blank(c)}) as present, count(*) filter ({_blank(c)}) as missing, {r2(f'(count(*) - count(*) filter ({_blank(c)})) * 1e0 / count(*) * 100e0')} as coverage_percent from {_U} u" for c in _COV))
def column_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A12, X11."""
    return reports.column_coverage(B.frame(spark, d, B.UNIVERSE), list(_COV))


@query(f"select k, {' + '.join(_if(_blank(c), '1', '0') for c in _COV)} as missing_count, concat_ws('|', {', '.join(f'case when {_blank(c)} then {chr(39)}{c}{chr(39)} end' for c in _COV)}) as missing_columns from {_U} u")
def missing_by_row(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    return reports.missing_by_row(B.frame(spark, d, B.UNIVERSE), "k", list(_COV))


@query()
def two_key_greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Sequential by nature, so no SQL; the tests compare it with the loop."""
    rows = B.frame(spark, d, B.CANDIDATES).withColumn("isin", F.nullif("isin", F.lit("")))  # no ISIN is no key
    return universe.greedy_two_keys(rows, "isin", "ticker").select("input_ordinal", "isin", "ticker", "accepted")


# ---------------------------------------------------------------- read models


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders) x where n = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The newest order of each customer."""
    return views.latest(B.frame(spark, d, "select * from {orders}"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("select o_custkey, o_orderkey, o_orderdate from (select *, rank() over (partition by o_custkey order by o_orderdate desc) as n from orders) x where n = 1")
def latest_with_ties(spark: SparkSession, d: str) -> DataFrame:
    """N5."""
    return views.latest(B.frame(spark, d, "select * from {orders}"), ["o_custkey"], "o_orderdate", ties=True).select("o_custkey", "o_orderkey", "o_orderdate")


@query("select o_custkey, count(*) as n, case when count(*) > 1 then arg_min(o_totalprice, o_orderkey) end as first_value, case when count(*) > 1 then arg_max(o_totalprice, o_orderkey) end as last_value, case when count(*) > 1 then arg_max(o_totalprice, o_orderkey) - arg_min(o_totalprice, o_orderkey) end as delta from orders group by 1")
def first_last_delta(spark: SparkSession, d: str) -> DataFrame:
    """N8."""
    return views.first_last(B.frame(spark, d, "select * from {orders}"), "o_custkey", "o_orderkey", "o_totalprice")


_FV = "(select c.c_custkey, c.c_name, c.c_acctbal, o.o_orderkey, o.o_totalprice, e.event_type, e.value from customer c left join (select * from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders) x where n = 1) o on o.o_custkey = c.c_custkey left join (select * from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) y where n = 1) e on e.user_id = c.c_custkey)"


def _final_view(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: B.frame(spark, d, f"select * from {{{t}}}")
    orders = views.latest(read("orders"), ["o_custkey"], "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    events = views.latest(read("events"), ["user_id"], "event_id").select(F.col("user_id").alias("c_custkey"), "event_type", "value")
    return views.final_view(read("customer").select("c_custkey", "c_name", "c_acctbal"), orders, events, "c_custkey")


@query(f"select * from {_FV} f")
def final_view(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their latest order and latest event."""
    return _final_view(spark, d)


@query(f"select * from {_FV} f order by c_acctbal desc, c_custkey limit 50")
def topn_final_view(spark: SparkSession, d: str) -> DataFrame:
    """T1, X15 (the limit is the feature)."""
    return views.top(_final_view(spark, d), 50, F.desc("c_acctbal"), key="c_custkey")


# ---------------------------------------------------------------- memos and flags

_MEMO = "select *, gross_margin * 100e0 as gm, (k % 260) * 1e0 as debt_to_equity, (k % 44 - 6) * 1e0 as roe, case when k % 3 = 0 then null else (k % 30 - 4) * 1e0 end as revenue_growth, (k % 22) / 10e0 as beta, (k % 12) * 1e0 as analyst_count from (" + B.FUNDAMENTALS + ") f"


def _memo_rows(spark: SparkSession, d: str) -> DataFrame:
    return B.frame(spark, d, _MEMO).withColumns({"pe": F.col("pe_ratio"), "price_to_sales": F.col("price_sales")})


_mm = {
    "fh": [("revenue_growth", [(25, 90), (10, 75), (0, 55)], 35), ("gross_margin", [(65, 90), (40, 75), (20, 55)], 35), ("operating_margin", [(25, 90), (10, 75), (0, 55)], 35), ("net_margin", [(20, 90), (8, 75), (0, 55)], 35), ("roe", [(25, 90), (10, 75), (0, 55)], 35), ("current_ratio", [(2.5, 90), (1.5, 75), (1, 55)], 35)],
    "gr": [("revenue_growth", [(30, 90), (15, 75), (0, 55)], 30)],
}
_lad2 = lambda c, ladder, last: "case when " + f"{c} is null then null " + " ".join(f"when {c} >= {a} then {v}e0" for a, v in ladder) + f" else {last}e0 end"
_low2 = lambda c, ladder, last: "case when " + f"{c} is null then null " + " ".join(f"when {c} <= {a} then {v}e0" for a, v in ladder) + f" else {last}e0 end"


def _mean_sql(parts: list[str]) -> str:
    n = " + ".join(f"case when ({p}) is null then 0 else 1 end" for p in parts)
    return r2(f"case when ({n}) > 0 then ({' + '.join(f'coalesce({p}, 0e0)' for p in parts)}) / ({n}) end")


_FH = _mean_sql([*[_lad2(*x) for x in _mm["fh"][:5]], _low2("debt_to_equity", [(50, 85), (120, 65), (250, 45)], 25), _lad2(*_mm["fh"][5])])
_GR = _mean_sql([_lad2(*_mm["gr"][0])])


@query(f"select k, {_FH} as financial_health_score, {_GR} as growth_analysis_score from ({_MEMO}) m")
def memo_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two of the seven modules have SQL; all are compared with hand-made rows in the tests."""
    return memo.memo_scores(_memo_rows(spark, d)).select("k", "financial_health_score", "growth_analysis_score")


@query()
def verdict(spark: SparkSession, d: str) -> DataFrame:
    """Memo verdicts after red flags."""
    return pipelines.memos(_memo_rows(spark, d), ["sector", "industry"]).select("k", "deterministic_score", "gap_count", "memo_status", "confidence", "final_verdict", "normalized_verdict", "red_flag_count", "enforced_verdict")


_FLAGROWS = [
    ("debt", "HIGH", "DEBT_NET_DEBT_EBITDA_GT_5", "net_debt_to_ebitda > 5"), ("debt", "MEDIUM", "DEBT_NET_DEBT_EBITDA_GT_3", "net_debt_to_ebitda > 3 and net_debt_to_ebitda <= 5"),
    ("margins", "HIGH", "OPERATING_MARGIN_LT_NEG_20", "operating_margin < -2e-1"), ("margins", "MEDIUM", "OPERATING_MARGIN_NEGATIVE", "operating_margin < 0 and operating_margin >= -2e-1"),
    ("fcf", "HIGH", "FCF_MARGIN_LT_NEG_10", "fcf_margin < -1e-1"), ("fcf", "MEDIUM", "FCF_MARGIN_NEGATIVE", "fcf_margin < 0 and fcf_margin >= -1e-1"),
    ("dilution", "HIGH", "DILUTION_3Y_GT_30", "shares_dilution_3y > 3e-1"), ("dilution", "MEDIUM", "DILUTION_3Y_GT_15", "shares_dilution_3y > 15e-2 and shares_dilution_3y <= 3e-1"),
    ("risk", "HIGH", "STAGE2_REJECTED", "stage2_status = 'REJECTED'"), ("risk", "MEDIUM", "STAGE2_WATCHLIST", "stage2_status = 'WATCHLIST'"),
    *[(c, s, code, f"stage2_all_reasons like '%{t}%'") for t, c, s, code in memo.BY_TOKEN],
]
_RF = " union all ".join(f"select k, '{c}' as category, '{s}' as severity, '{code}' as code from {_S2} s where {w}" for c, s, code, w in _FLAGROWS)


@query(_RF)
def red_flags(spark: SparkSession, d: str) -> DataFrame:
    """C20, R7."""
    return memo.red_flag_rows(memo.red_flags(_stage2(spark, d), ["stage2_all_reasons"]), "k").select("k", "category", "severity", "code")


@query(f"select b.k, coalesce(n, 0) as red_flag_count, coalesce(h, 0) as high_count, case when h > 0 then 'HIGH' when f.md > 0 then 'MEDIUM' else 'LOW' end as max_severity, coalesce(h > 0, false) as has_high_or_critical from {_S2} b left join (select k, count(*) as n, count(*) filter (severity = 'HIGH') as h, count(*) filter (severity = 'MEDIUM') as md from ({_RF}) r group by 1) f on f.k = b.k")
def red_flag_summary(spark: SparkSession, d: str) -> DataFrame:
    """A30, J15."""
    out = memo.red_flag_summary(memo.red_flags(_stage2(spark, d), ["stage2_all_reasons"]), "k")
    return out.select("k", "red_flag_count", "high_count", "max_severity", "has_high_or_critical")


@query("""select c.c_custkey, case when s in ('REVIEWED') or m = 'DONE' then 'REVIEWED' when s = 'IN_PROGRESS' or m = 'IN_PROGRESS' then 'IN_PROGRESS' when s = 'REJECTED' then 'REJECTED' else 'PENDING_REVIEW' end as queue_status, c_acctbal / 100e0 as score
from customer c left join (select s_suppkey, case s_suppkey % 4 when 0 then 'reviewed' when 1 then 'in_progress' when 2 then 'rejected' else '' end as r, upper(case s_suppkey % 4 when 0 then 'reviewed' when 1 then 'in_progress' when 2 then 'rejected' else '' end) as s, case when s_suppkey % 6 = 5 then 'DONE' else '' end as m from supplier) k on k.s_suppkey = c.c_custkey""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """C23, X14."""
    cards = B.frame(spark, d, "select s_suppkey as c_custkey, case s_suppkey % 4 when 0 then 'reviewed' when 1 then 'in_progress' when 2 then 'rejected' else '' end as research_status, case when s_suppkey % 6 = 5 then 'DONE' else '' end as manual_status from {supplier}")
    ranking = B.frame(spark, d, "select c_custkey, c_acctbal / 100e0 as score from {customer}")
    return pipelines.research_queue(ranking, cards, "c_custkey").select("c_custkey", "queue_status", "score")


# ---------------------------------------------------------------- scalar functions


@query("select p_partkey, p_retailprice * 1e3 as parsed from part where p_partkey % 3 = 0 union all select p_partkey, -p_size * 1e6 from part where p_partkey % 3 = 1 union all select p_partkey, null from part where p_partkey % 3 = 2")
def money_parse(spark: SparkSession, d: str) -> DataFrame:
    """thousands, millions in parentheses, nothing."""
    df = B.frame(spark, d, "select p_partkey, case p_partkey % 3 when 0 then '$' || cast(p_retailprice as string) || 'K' when 1 then '(' || cast(p_size as string) || 'M)' else 'n/a' end as raw from {part}")
    return df.select("p_partkey", X.money("raw").alias("parsed"))


@query("select p_partkey, case when p_partkey % 2 = 0 then p_size / 100e0 when p_size / 10e0 > 15e-1 then p_size / 10e0 / 100e0 else p_size / 10e0 end as parsed from part")
def percent_or_ratio(spark: SparkSession, d: str) -> DataFrame:
    """F6."""
    df = B.frame(spark, d, "select p_partkey, case when p_partkey % 2 = 0 then cast(p_size as string) || '%' else cast(p_size / 10e0 as string) end as raw from {part}")
    return df.select("p_partkey", X.percent_or_ratio("raw").alias("parsed"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as prop_k from events")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    """F28, F29, P20."""
    return B.frame(spark, d, "select event_id, props from {events}").select("event_id", F.from_json("props", "k bigint")["k"].alias("prop_k"))


@query("select n_nationkey, r_name as region from nation join region on r_regionkey = n_regionkey")
def region_map(spark: SparkSession, d: str) -> DataFrame:
    """codes to names by a lookup table small enough to broadcast."""
    nation, region = B.frame(spark, d, "select * from {nation}"), B.frame(spark, d, "select r_regionkey, r_name from {region}")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("region"))


@query("select source, count(*) as documents, count(l.doc_id) as labelled, sum(coalesce(l.quality, 0)) as good from documents d left join labels l on l.doc_id = d.doc_id group by 1")
def labelled_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of a labelled side by provider."""
    docs, labels = B.frame(spark, d, "select doc_id, source from {documents}"), B.frame(spark, d, "select doc_id, quality, 1 as has from {labels}")
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("has").alias("labelled"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"))


@query("select 'orders' as table_name, count(*) as rows from orders union all select 'events', count(*) from events union all select 'conversations', count(*) from conversations")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """A26."""
    return reports.table_counts({t: B.frame(spark, d, f"select * from {{{t}}}") for t in ("orders", "events", "conversations")})


@query("select date_trunc('month', o_orderdate) as period, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as cost, sum(cast(o_totalprice as decimal(18,2))) > 20000000 as over_limit from orders group by 1")
def spend_by_month(spark: SparkSession, d: str) -> DataFrame:
    """A40, A27."""
    df = B.frame(spark, d, "select o_orderdate, cast(o_totalprice as decimal(18,2)) as cost from {orders}")
    return reports.spend(df, "o_orderdate", "cost", "month", 20_000_000).withColumn("cost", F.col("cost").cast("double"))


@query()
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """S14 (paths have no SQL)."""
    from .sources.readers import file_manifest as manifest

    return manifest(spark, f"{d}/*").select("size", "sha256", "ticker")


# ---------------------------------------------------------------- diagnostics


@query(f"select k, case when {' or '.join(f'n like {chr(39)}%{w}%{chr(39)}' for w in diagnostics.HKEX_OTHER)} then 'NON_ORDINARY_OR_REVIEW_REQUIRED' when {' or '.join(f'n like {chr(39)}%{w}%{chr(39)}' for w in diagnostics.HKEX_EQUITY)} then 'EQUITY_CANDIDATE_DIAGNOSTIC_ONLY' else 'UNKNOWN_REVIEW_REQUIRED' end as diagnostic_class from (select k, lower(name) as n from ({B.NAMES}) a) b")
def diagnostic_class(spark: SparkSession, d: str) -> DataFrame:
    """C15."""
    return B.frame(spark, d, B.NAMES).select("k", diagnostics.diagnostic_class([F.col("name")], diagnostics.HKEX_OTHER, diagnostics.HKEX_EQUITY).alias("diagnostic_class"))


@query(f"select k, symbol, case when k % 2 = 0 then 'MEDIUM' else 'LOW' end as classification_confidence from (select *, row_number() over (partition by symbol order by k) as n from ({B.NAMES}) a where regexp_matches(symbol, '^[A-Z0-9][A-Z0-9.\\-]{{{{0,15}}}}$')) b where n = 1")
def symbol_screen(spark: SparkSession, d: str) -> DataFrame:
    """C32, P16."""
    df = B.frame(spark, d, B.NAMES)
    route = F.when(F.col("k") % 2 == 0, F.lit("listed_symbols")).otherwise(F.lit("symbols_traded"))
    return diagnostics.symbol_screen(df, "symbol", "name", None, route, "k").select("k", "symbol", "classification_confidence")


@query(f"select count(*) as rows, count(*) filter (trim(ticker) = '') as empty_tickers, count(distinct nullif(upper(trim(ticker)), '')) as unique_tickers, count(*) filter (trim(ticker) <> '') - count(distinct nullif(upper(trim(ticker)), '')) as duplicate_tickers, 6 as columns from ({B.CANDIDATES}) c")
def table_profile(spark: SparkSession, d: str) -> DataFrame:
    """A35, A37."""
    return reports.table_profile(B.frame(spark, d, B.CANDIDATES), "ticker")


@query(f"select (select count(distinct ticker) from ({B.CANDIDATES}) c) as keys, (select count(distinct ticker) from ({B.CANDIDATES}) c where ticker in (select ticker from ({B.BASELINE}) b)) as covered, (select count(distinct ticker) from ({B.CANDIDATES}) c where ticker in (select ticker from ({B.BASELINE}) b)) / (select count(distinct ticker) from ({B.CANDIDATES}) c) as coverage")
def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """J19."""
    return views.coverage_ratio(B.frame(spark, d, B.BASELINE), B.frame(spark, d, B.CANDIDATES), "ticker")


@query(f"select stage1_status, count(*) filter (market_cap_bucket = '<100M') as \"<100M\", count(*) filter (market_cap_bucket = '1B-10B') as \"1B-10B\" from (select stage1_status, {case(('market_cap is null', chr(39) + 'missing' + chr(39)), ('market_cap < 1e8', chr(39) + '<100M' + chr(39)), ('market_cap < 1e9', chr(39) + 'x' + chr(39)), ('market_cap < 1e10', chr(39) + '1B-10B' + chr(39)), default=chr(39) + 'y' + chr(39))} as market_cap_bucket from {_S1} s) b group by 1")
def status_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Wide counts."""
    return reports.status_matrix(reports.bucketed(_stage1(spark, d)), "stage1_status", "market_cap_bucket", ["<100M", "1B-10B"])


@query("select o_custkey, sum(case when o_orderstatus = 'F' then 1 else 0 end) as done, row_number() over (order by sum(o_totalprice * 0) + count(*) desc, o_custkey) as rank from orders group by o_custkey order by rank limit 100")
def ranked_customers(spark: SparkSession, d: str) -> DataFrame:
    """Ranks are taken after the limit, so no task sorts all rows."""
    df = B.frame(spark, d, "select o_custkey, o_orderstatus from {orders}")
    counts = df.groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("done"), F.count(F.lit(1)).alias("n"))
    best = views.top(counts, 100, F.desc("n"), key="o_custkey")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "o_custkey"))).drop("n")


from . import listing_queries, rule_queries  # noqa: E402, F401  they register their queries here
