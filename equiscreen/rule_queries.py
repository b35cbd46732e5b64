"""Queries of the smaller rule sets on the driver's tables; their SQL is written from the rules, not from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as B
from .functions import exprs as X
from .operators import market, memo, reports, scoring, universe, views
from .queries import _LT, _S3, SQL, _quality, _stage3, case, query, r2

_t = lambda c: f"coalesce(trim(cast({c} as varchar)), '')"
_in = lambda c, words: f"{c} in ({', '.join(repr(w) for w in words)})"

# ---------------------------------------------------------------- classifiers

_TYPES = f"select k, name, symbol, case k % 7 when 0 then 'Subscription Right' when 1 then 'Namens-Aktien' when 2 then 'Zertifikat' when 3 then null when 4 then 'GDR programme' when 5 then 'Equity' else 'other' end as kind from ({B.NAMES}) n"
_NON_EQUITY = [
    ("etf", r"\betf\b|exchange traded fund|active etf"), ("etn", r"\betn\b|exchange traded note"), ("etc", r"\betc\b|exchange traded commodit"), ("etp", r"\betp\b|exchange traded product"), ("fund", r"\bfund\b|\bfonds\b|investment fund|mutual fund"),
    ("bond", r"\bbond\b|\banleihe\b|fixed income|debt"), ("certificate", "certificate|zertifikat|certificat"), ("warrant", "warrant|optionsschein"), ("derivative", "future|option|derivative|swap"), ("commodity", "commodity|rohstoff"), ("crypto", "crypto|bitcoin|ethereum"),
    ("index", r"\bindex\b|indice"), ("reit", r"\breit\b|real estate investment trust"), ("rights_or_units", r"subscription right|rights issue|\bright\b|\bunit\b"), ("depositary_receipt", r"depositary receipt|\badr\b|\bgdr\b"),
]
_EQUITY = r"\b(equity|equities|share|shares|stock|stocks|common|ordinary|aktie|aktien|stammaktie|vorzugsaktie|inhaber-?aktien|namens-?aktien)\b|\bregistered shares?\b|\bbearer shares?\b"
_S = "lower(coalesce(trim(symbol), '') || ' | ' || coalesce(trim(kind), '') || ' | ' || coalesce(trim(name), ''))"


@query(f"select k, case when reason <> '' then 'excluded_non_common_equity' when regexp_matches(s, '{_EQUITY}') then 'equity_like_candidate' else 'manual_review_unknown_type' end as class, case when reason <> '' then reason when regexp_matches(s, '{_EQUITY}') then 'equity_pattern' else 'insufficient_type_signal' end as reason from (select k, s, " + case(*[(f"regexp_matches(s, '{p}')", f"'{r}'") for r, p in _NON_EQUITY], default="''") + f" as reason from (select k, {_S} as s from ({_TYPES}) t) y) x")
def regex_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """C12, C33."""
    return B.frame(spark, d, _TYPES).select("k", universe.regex_taxonomy("symbol", "kind", "name").alias("c")).select("k", "c.class", "c.reason")


_CASES = f"select k, ticker || case when k % 3 = 0 then 'Y' else '' end as ticker, case k % 6 when 0 then 'etf' when 1 then 'EQUITY' when 2 then ' adr' when 3 then '' when 4 then null else 'MutualFund' end as quote_type, case when k % 8 = 0 then 'Reit unit' else asset_type end as asset_type, case when k % 10 = 0 then 'Mortgage REITs' else sector end as sector, industry, case k % 4 when 0 then 'USA' when 1 then 'Japan' when 2 then null else '' end as country from ({B.UNIVERSE}) u"


@query(f"""select k, case when a || b || c = '' then 'none' else concat_ws('|', nullif(a, ''), nullif(b, ''), nullif(c, '')) end as special from (select k, case when upper({_t('asset_type')}) like '%REIT%' or lower({_t('sector')}) like '%reit%' or lower({_t('industry')}) like '%reit%' then 'REIT' else '' end as a,
case when upper({_t('quote_type')}) not in ('', 'EQUITY', 'ADR') then 'QUOTE_TYPE_' || upper({_t('quote_type')}) else '' end as b, case when {_t('ticker')} like '%Y' and country not in ('United States', 'USA', 'US') then 'POSSIBLE_ADR' else '' end as c from ({_CASES}) x) y""")
def special_cases(spark: SparkSession, d: str) -> DataFrame:
    """C19."""
    return B.frame(spark, d, _CASES).select("k", memo.special_case_inference("ticker", "quote_type", "asset_type", "sector", "industry", "country").alias("special"))


_CARDS = f"select k, case k % 5 when 0 then 'Datos insuficientes' when 1 then 'Alta calidad' when 2 then null when 3 then 'Alta calidad, revisar' else 'insufficient' end as category, case when k % 7 = 0 then null else (k % 20) / 2e0 end as confidence, case when k % 11 = 0 then null else (k % 18) / 2e0 end as evidence, case when k % 6 = 0 then null else k % 9 end as limitations, (k % 64) / 8e0 as risk from ({B.UNIVERSE}) u"


@query(f"select k, lower(coalesce(category, '')) like '%datos insuficientes%' or coalesce(confidence < 4, false) or coalesce(evidence < 4, false) or coalesce(limitations >= 5, false) as warning from ({_CARDS}) c")
def prudence(spark: SparkSession, d: str) -> DataFrame:
    """C25."""
    return B.frame(spark, d, _CARDS).select("k", memo.prudence_warning(F.col("category"), F.col("confidence"), F.col("evidence"), F.col("limitations")).alias("warning"))


@query(f"select count(*) as companies, avg(case when confidence is not null then confidence end) as avg_confidence, avg(risk) as avg_risk, count(*) filter (category like '%Alta calidad%') as high_quality_count, count(*) filter (category like '%Datos insuficientes%') as insufficient_data_count from ({_CARDS}) c")
def history_summary(spark: SparkSession, d: str) -> DataFrame:
    """A33; confidence and risk are halves and eighths, so the sums are exact in any order."""
    return reports.history_summary(B.frame(spark, d, _CARDS), "category", "confidence", "risk")


_MANUAL = f"select k as input_ordinal, case when k % 9 = 0 then ' ' when k % 4 = 0 then 'D' || cast(k % 50 as string) else ticker end as ticker, case k % 6 when 0 then 'abc' when 1 then '' else '12.5' end as price, case when k % 8 = 0 then 'n/a' else '1000' end as market_cap, '5' as volume, case when k % 7 = 0 then '-' else '3' end as average_volume, case k % 5 when 0 then '150' when 1 then 'x' when 2 then '' else '2.5' end as change_1d_pct, case when k % 10 = 0 then '-101' else '100' end as change_5d_pct, cast(null as string) as change_20d_pct from ({B.UNIVERSE}) u"
_BAD = lambda c: f"({_t(c)} <> '' and try_cast({_t(c)} as double) is null)"
_M = f"(select *, {_t('ticker')} <> '' as named, row_number() over (partition by upper({_t('ticker')}) order by input_ordinal) > 1 as again from ({_MANUAL}) m)"
_M_CASES = [("not named", "ERROR", "ticker", "Empty ticker"), ("named and again", "WARNING", "ticker", "Duplicate ticker")] + [(f"named and {_BAD(c)}", "ERROR", c, "Non numeric") for c in ("price", "market_cap", "volume", "average_volume", "change_1d_pct", "change_5d_pct", "change_20d_pct")] + [(f"named and abs(try_cast({_t(c)} as double)) > 100", "WARNING", c, "Suspicious percentage") for c in ("change_1d_pct", "change_5d_pct", "change_20d_pct")]


@query(" union all ".join(f"select input_ordinal, '{level}' as level, '{field}' as field, '{message}' as message from {_M} m where {when}" for when, level, field, message in _M_CASES))
def market_row_issues(spark: SparkSession, d: str) -> DataFrame:
    """C28."""
    return memo.issue_rows(memo.validate_market_rows(B.frame(spark, d, _MANUAL)), "input_ordinal")


# ---------------------------------------------------------------- scores

_META = f"select k, ticker, case when k % 12 = 0 then '' else company_name end as name, case k % 6 when 0 then 'xetra' when 1 then 'EPA' when 2 then 'BMV' when 3 then '' else exchange end as exchange, case k % 5 when 0 then 'us' when 1 then 'MX' when 2 then null when 3 then 'JP' else '' end as country, case k % 4 when 0 then 'Technology' when 1 then 'Energy' when 2 then '' else 'Healthcare' end as sector, case when k % 9 = 0 then '' else industry end as industry, k as position from ({B.UNIVERSE}) u"
_MS = r2(f"35e-2 * c + 2e-1 * case when {_in("upper(" + _t("exchange") + ")", ('NASDAQ', 'NYSE', 'LSE', 'XETRA', 'EPA', 'TSE', 'AMS', 'BME', 'SWX', 'HKEX'))} then 1e2 when {_t('exchange')} <> '' then 6e1 else 2e1 end + 2e-1 * case when {_in("upper(" + _t("country") + ")", ('US', 'CA', 'GB', 'UK', 'NL', 'DE', 'FR', 'ES', 'IT', 'CH', 'SE', 'DK', 'NO', 'FI', 'JP', 'AU', 'IE'))} then 1e2 when {_t('country')} <> '' then 6e1 else 2e1 end + 15e-2 * case when {_in(_t('sector'), ('Technology', 'Healthcare', 'Industrials', 'Financial Services', 'Consumer Defensive', 'Communication Services', 'Semiconductors'))} then 85e0 when {_t('sector')} <> '' then 65e0 else 2e1 end + 5e-2 * case when {_t('industry')} <> '' then 8e1 else 2e1 end + 5e-2 * greatest(4e1, 1e2 - (position - 1) * 2e0)")


@query(f"""select k, c as metadata_completeness_score, s as metadata_score, case when s >= 85 then 'metadata_high' when s >= 65 then 'metadata_medium' else 'metadata_low' end as metadata_category from (select k, c, {_MS} as s from (select *,
{r2(f"100e0 * ({' + '.join(f'case when {_t(c)} <> {chr(39) * 2} then 1 else 0 end' for c in ('ticker', 'exchange', 'country', 'sector', 'industry'))} + case when {_t('name')} <> '' or {_t('ticker')} <> '' then 1 else 0 end) / 6e0")} as c from ({_META}) m) x) y""")
def metadata_score(spark: SparkSession, d: str) -> DataFrame:
    """K11."""
    return scoring.metadata_score(B.frame(spark, d, _META), "position").select("k", "metadata_completeness_score", "metadata_score", "metadata_category")


_PARTS = ("revenue_ttm", "operating_margin", "fcf_margin", "net_debt_to_ebitda", "financial_data_date", "special_case")
_HAS = lambda c: f"(case when cast({c} as varchar) is not null and cast({c} as varchar) not in ('', 'None') then 1e0 else 0e0 end)"


@query(f"select k, {r2('100e0 * (' + ' + '.join(_HAS(c) for c in _PARTS) + ' + 5e-1 * ' + _HAS('shares_dilution_3y') + ') / 65e-1')} as completeness from ({B.FUNDAMENTALS}) f")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    """K16."""
    return B.frame(spark, d, B.FUNDAMENTALS).select("k", scoring.completeness([*_PARTS, "shares_dilution_3y"], {"shares_dilution_3y": 0.5}).alias("completeness"))


@query(f"select k, floor((greatest(q, 0) / 1e6 * 25e-1 + greatest(m, 0) / 1e6 * 1e1) * 1e6 + 5e-1) / 1e6 as cost, greatest(0e0, 1e2 - (k % 7) * 2e1 - (k % 5) * 5e0) as readiness, greatest(1e0, 1e2 - (k - 1)) as order_score from ({B.UNIVERSE}) u")
def small_scores(spark: SparkSession, d: str) -> DataFrame:
    """K12, K18, K22."""
    k = F.col("k")
    return B.frame(spark, d, B.UNIVERSE).select("k", scoring.request_cost(F.col("q"), F.col("m"), 2.5, 10.0).alias("cost"), scoring.readiness(k % 7, k % 5).alias("readiness"), scoring.order_score(k).alias("order_score"))


# ---------------------------------------------------------------- functions

_WORDS = f"select k, case k % 13 when 0 then 'TRUE' when 1 then ' Yes ' when 2 then 'si' when 3 then 'active' when 4 then 'no' when 5 then '0' when 6 then 'Especial' when 7 then '1' when 8 then null when 9 then 'inactivo' when 10 then 'sí' when 11 then 'y' else 'maybe' end as w, case k % 6 when 0 then 'A' when 1 then 'N' when 2 then 'P' when 3 then 'Z' when 4 then 'V' else 'Q' end as code, case k % 5 when 0 then 'us' when 1 then ' Canada' when 2 then 'Mexico' when 3 then null else 'United States of America' end as country, case when k % 4 = 0 then null else 'us' || cast(k as string) end as isin from ({B.UNIVERSE}) u"


@query(f"""select k, lower({_t('w')}) in ('true', '1', 'yes', 'y') as plain, lower({_t('w')}) in ('true', '1', 'yes', 'y', 'si', 'sí', 'special', 'especial') as special, case when lower({_t('w')}) in ('true', '1', 'yes', 'y', 'si', 'sí', 'active', 'activo') then true when lower({_t('w')}) in ('false', '0', 'no', 'n', 'inactive', 'inactivo') then false end as wide,
case code when 'A' then 'AMEX' when 'N' then 'NYSE' when 'P' then 'ARCA' when 'Z' then 'BATS' when 'V' then 'IEXG' end as exchange, case when upper({_t('country')}) in ('USA', 'US', 'UNITED STATES', 'UNITED STATES OF AMERICA', 'CANADA', 'CA') then 'North America' else 'Unknown' end as region, upper(substr({_t('isin')}, 1, 2)) as isin_country from ({_WORDS}) w""")
def vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """F14, F15, F17, F31."""
    pairs = F.create_map(*[F.lit(x) for kv in universe.EXCHANGE_CODES_SHORT.items() for x in kv])
    return B.frame(spark, d, _WORDS).select("k", X.two_state("w").alias("plain"), X.special_state("w").alias("special"), X.tri_state("w").alias("wide"), F.try_element_at(pairs, F.col("code")).alias("exchange"), X.region("country").alias("region"), X.isin_country("isin").alias("isin_country"))


_RAW = f"select k, case when k % 3 = 0 then null else q end as net_debt, case when k % 4 = 0 then null else m end as total_debt, q * 2 as cash, case when k % 5 = 0 then 1e-1 end as fcf_margin, q * 3 as free_cash_flow, case when k % 7 = 0 then 0e0 else m * 2 end as revenue_ttm, cast(null as double) as net_debt_to_ebitda, case when k % 6 = 0 then null when k % 11 = 0 then 0e0 else m / 4 end as ebitda from ({B.UNIVERSE}) u"


@query(f"select k, nd as net_debt, coalesce(fcf_margin, case when revenue_ttm <> 0 then free_cash_flow / revenue_ttm end) as fcf_margin, coalesce(net_debt_to_ebitda, case when ebitda <> 0 then nd / ebitda end) as net_debt_to_ebitda from (select *, coalesce(net_debt, total_debt - cash) as nd from ({_RAW}) r) x")
def derived_ratios(spark: SparkSession, d: str) -> DataFrame:
    """F10."""
    return X.derived_ratios(B.frame(spark, d, _RAW)).select("k", "net_debt", "fcf_margin", "net_debt_to_ebitda")


# ---------------------------------------------------------------- reviews, listings, prices

_OLD = f"select ticker, case k % 7 when 0 then 'reviewed_watchlist' when 1 then 'reviewed_reject' when 2 then 'needs_more_data' when 3 then 'done' when 4 then 'pending_review' else null end as manual_status, case when k % 3 = 0 then null else 'note ' || cast(k as string) end as notes from ({B.UNIVERSE}) u where trim(ticker) <> '' and m > 100000"
_NEW = f"select ticker, k from ({B.UNIVERSE}) u where trim(ticker) <> ''"


@query(f"select n.ticker, case when o.manual_status in ('pending_review', 'reviewed_watchlist', 'reviewed_reject', 'needs_more_data') then o.manual_status else 'pending_review' end as manual_status, coalesce(o.notes, '') as notes from ({_NEW}) n left join ({_OLD}) o on o.ticker = n.ticker")
def review_states(spark: SparkSession, d: str) -> DataFrame:
    """J16."""
    return views.review_queue(B.frame(spark, d, _NEW), B.frame(spark, d, _OLD)).select("ticker", "manual_status", "notes")


_CLEAN = f"select k as input_ordinal, case when k % 4 = 0 then ' t' || cast(k % 60 as string) else ticker end as ticker, case k % 5 when 0 then 'usa' when 1 then 'MX' else 'USA' end as country, case when k % 9 = 0 then 'EUR' else 'usd ' end as currency, case k % 6 when 0 then 'Equity' when 1 then 'Common Stock' when 2 then 'etf' when 3 then 'stock' else 'common_stock' end as asset_type, case k % 7 when 0 then 'active' when 1 then 'no' when 2 then '1' else 'Yes' end as is_active from ({B.UNIVERSE}) u"


@query(f"select input_ordinal, t as ticker from (select *, upper({_t('ticker')}) as t, row_number() over (partition by upper({_t('ticker')}) order by input_ordinal) as n from ({_CLEAN}) c) x where t <> '' and n = 1 and upper(trim(country)) = 'USA' and upper(trim(currency)) = 'USD' and lower(trim(asset_type)) in ('equity', 'common stock', 'commonstock', 'stock', 'common_stock') and lower(trim(is_active)) in ('true', '1', 'yes', 'y')")
def clean_universe(spark: SparkSession, d: str) -> DataFrame:
    """P10, F16, R1."""
    return universe.clean_universe(B.frame(spark, d, _CLEAN)).select("input_ordinal", "ticker")


@query(f"select ticker, last as regular_market_price, prev as previous_close, volume, a as average_volume from (select ticker, {'floor(max(c) filter (n = 1) * 1e4 + 5e-1) / 1e4'} as last, {'floor(max(c) filter (n = 2) * 1e4 + 5e-1) / 1e4'} as prev, max(v) filter (m = 1) as volume, {r2('avg(v) filter (m <= 20)')} as a from (select ticker, close as c, volume as v, case when close is not null then row_number() over (partition by ticker, close is null order by date desc, close nulls first) end as n, case when volume is not null then row_number() over (partition by ticker, volume is null order by date desc, close nulls first) end as m from ({B.PRICES}) p) x group by ticker) y")
def adapter_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Closes and volumes are numbered apart; the changes are tested on hand-made rows."""
    return market.adapter_metrics(B.frame(spark, d, B.PRICES)).select("ticker", "regular_market_price", "previous_close", "volume", "average_volume")


_XETRA = "select c_custkey as input_ordinal, case when c_custkey % 11 = 0 then 'ETF' when c_custkey % 23 = 0 then '' else 'CS' end as instrument_type, case when c_custkey % 7 = 0 then '' else 'ISIN' || cast(c_custkey % 700 as string) end as isin, case when c_custkey % 13 = 0 then '' else 'S' || cast(c_custkey % 400 as string) end as ticker from {customer}"


@query()
def xetra_decisions(spark: SparkSession, d: str) -> DataFrame:
    """C17: the last two reasons depend on what was accepted before, so no SQL; the tests compare it with the loop."""
    base = B.frame(spark, d, "select 'XETR' as exchange, 'S' || cast(s_suppkey % 90 as string) as ticker, 'ISIN' || cast(s_suppkey as string) as isin from {supplier}")
    return universe.xetra_decisions(B.frame(spark, d, _XETRA), base).select("input_ordinal", "isin", "ticker", "exclusion_reason")


# ---------------------------------------------------------------- reads and projections

_BRIDGE = {"ticker": "ticker", "company_name": "company_name", "sector": "sector", "industry": "industry", "country": "country", "market_cap": "market_cap", "score": "final_stage3_score", "category": "stage3_category"}


@query(f"select ticker, company_name, sector, industry, cast(null as varchar) as country, market_cap, final_stage3_score as score, stage3_category as category, 'stage3_opportunity_scoring' as source from {_S3} s")
def bridge_projection(spark: SparkSession, d: str) -> DataFrame:
    """P8."""
    return views.bridge(_stage3(spark, d), _BRIDGE, "stage3_opportunity_scoring")


_CANONICAL = ["ticker", "company_name", "exchange", "country", "phone", "isin", "source_provider"]


@query("""select cast(s_suppkey as varchar) as ticker, trim(s_name) as company_name, 'TSE' as exchange, 'JP' as country, '' as phone, '' as isin, 'JPX' as source_provider from supplier
union all select cast(c_custkey as varchar), trim(c_name), trim(c_mktsegment), '', '', cast(c_nationkey as varchar), 'XETRA' from customer""")
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two providers' rows in one form."""
    jpx = views.canonical(B.frame(spark, d, "select * from {supplier}"), {"ticker": "s_suppkey", "company_name": "s_name", "phone": "s_fax"}, {"exchange": "TSE", "country": "JP", "source_provider": "JPX"}, _CANONICAL)
    xetra = views.canonical(B.frame(spark, d, "select * from {customer}"), {"ticker": "c_custkey", "company_name": "c_name", "exchange": "c_mktsegment", "isin": "c_nationkey"}, {"source_provider": "XETRA"}, _CANONICAL)
    return jpx.unionByName(xetra)


@query(f"select ticker, filter_reasons from ({SQL['basic_filters']}) f where not passes_basic_filters")
def excluded_companies(spark: SparkSession, d: str) -> DataFrame:
    """P13."""
    return views.passed(market.basic_filters(_quality(spark, d)), False).select("ticker", "filter_reasons")


@query(f"select ticker from ({SQL['basic_filters']}) f where passes_basic_filters")
def passed_companies(spark: SparkSession, d: str) -> DataFrame:
    """P13."""
    return views.passed(market.basic_filters(_quality(spark, d))).select("ticker")


_SIGNALS = "select o_orderkey as id, 'C' || cast(o_custkey as string) as ticker, o_orderpriority as run_id, o_totalprice as score_priority, o_orderdate from {orders}"


@query(f"select id, ticker, score_priority from ({_SIGNALS}) s where id = 7 union all select id, ticker, score_priority from (select * from ({_SIGNALS}) s where run_id = '1-URGENT' and ticker = 'C7' order by score_priority desc, id limit 1) t")
def point_lookups(spark: SparkSession, d: str) -> DataFrame:
    """P18 (one row is the feature)."""
    signals = B.frame(spark, d, _SIGNALS)
    return views.by_id(signals, 7).unionByName(views.by_ticker(signals, " c7", "1-URGENT")).select("id", "ticker", "score_priority")


@query("select o_orderkey as id, o_totalprice as score_priority from orders where o_orderdate = (select max(o_orderdate) from orders)")
def latest_run_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the latest run, by score."""
    signals = B.frame(spark, d, "select o_orderkey as id, o_orderdate as run_id, o_totalprice as score_priority from {orders}")
    runs = signals.groupBy("run_id").agg(F.max("run_id").alias("created_at"))
    return views.run_rows(signals, runs, F.desc("score_priority"), "id").select("id", "score_priority")


@query("select event_id as id, user_id as signal_id, ts as created_at, event_type as feedback_label, c_mktsegment as run_id from events join customer on c_custkey = user_id where c_mktsegment = 'BUILDING'")
def feedback_signals(spark: SparkSession, d: str) -> DataFrame:
    """J3."""
    feedback = B.frame(spark, d, "select event_id as id, user_id as signal_id, ts as created_at, event_type as feedback_label from {events}")
    return views.feedback_of_run(feedback, B.frame(spark, d, "select c_custkey as id, c_mktsegment as run_id from {customer}"), "BUILDING").select("id", "signal_id", "created_at", "feedback_label", "run_id")


_REVIEWS = "select case o_orderstatus when 'F' then 'reviewed_watchlist' when 'O' then 'pending_review' when 'P' then 'reviewed_reject' else 'done' end as manual_status from {orders}"


@query(f"select s.manual_status, count(r.manual_status) as n from (select 'pending_review' as manual_status union all select 'reviewed_watchlist' union all select 'reviewed_reject' union all select 'needs_more_data') s left join ({_REVIEWS}) r on r.manual_status = s.manual_status group by s.manual_status")
def review_counts(spark: SparkSession, d: str) -> DataFrame:
    """A31."""
    return views.review_counts(B.frame(spark, d, _REVIEWS))


_said = lambda none, *xs: "coalesce(nullif(concat_ws(', ', " + ", ".join(f"case when {w} then '{t}' end" for t, w in xs) + f"), ''), '{none}')"


@query(
    "select input_ordinal, 'LOCAL_SCORE_V0 ' || printf('%.2f', local_score_v0) || ': sube por ' || "
    + _said("sin fortalezas destacadas", ("datos de mercado completos", "market_data_component_score >= 80"), ("liquidez/tamaño razonables", "liquidity_component_score >= 80"), ("momentum sin extremos", "momentum_component_score >= 75"), ("buena calidad/fuente de datos", "data_quality_component_score >= 85"))
    + " || '; revisar por ' || "
    + _said("sin alertas fuertes", ("penalizaciones por datos faltantes o extremos", "penalty_score >= 20"), ("sin market data usable", "stage3_status = 'METADATA_SCORE_FALLBACK'"), ("errores de proveedor", "trim(error) <> ''"))
    + f" || '. No es recomendación financiera.' as reason from {_LT} t"
)
def local_reason(spark: SparkSession, d: str) -> DataFrame:
    """F26."""
    scored = scoring.local_score(B.frame(spark, d, B.LOCAL))
    return scored.select("input_ordinal", scoring.local_reason(scored).alias("reason"))


@query("""select event_id, user_id as record_user, value as record_scores_risk_score, event_type as record_scores_kind, '["' || event_type || '", "' || cast(user_id as varchar) || '"]' as record_tags, value as risk_score from events""")
def flattened_records(spark: SparkSession, d: str) -> DataFrame:
    """F28."""
    return X.flattened(B.frame(spark, d, "select event_id, named_struct('user', user_id, 'scores', named_struct('risk_score', value, 'kind', event_type), 'tags', array(event_type, cast(user_id as string))) as record from {events}"))


_JSONS = """select event_id, user_id, event_type, case event_id % 5 when 0 then '' when 1 then null when 2 then '["' || event_type when 3 then '["' || event_type || '"]' else '["a","' || event_type || '","b"]' end as listed from {events}"""


@query("""select event_id, case event_id % 5 when 3 then event_type when 4 then 'a|' || event_type || '|b' else 'none' end as items,
sha256('{{"event_id": ' || event_id || ', "event_type": "' || event_type || '", "user_id": ' || user_id || '}}') as memo_sha256 from events""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """lists read with a fallback, and the hash of a record written with its keys sorted."""
    items = X.parsed_json(F.col("listed"), "array<string>", F.array(F.lit("none")))
    rows = B.frame(spark, d, _JSONS)
    return rows.select("event_id", F.array_join(items, "|").alias("items"), X.fingerprint(rows, "user_id", "event_type", "event_id").alias("memo_sha256"))
