"""Scores by column arithmetic (K1-K3, K8-K13, K15, K16, K18, K20-K22) and the joins they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.rules import first_of
from ..plans.policies import SENSITIVITY
from .market import missing
from .orderings import counted, ranked


def _add(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _if(when: Column, then: float, other: float = 0.0) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(float(then))).otherwise(F.lit(float(other)))


def priority(df: DataFrame) -> DataFrame:
    """K1-K3: sub-scores, penalties, priority, category, veto and reasons of a snapshot that has quality and filter columns."""
    c1, c5, c20, rv = (X.real(c) for c in ("change_1d", "change_5d", "change_20d", "relative_volume"))
    high, quality, passes = X.real("distance_to_52w_high"), F.coalesce(X.real("data_quality_score"), F.lit(0.0)), F.coalesce(F.col("passes_basic_filters"), F.lit(False))
    some = lambda c, k: F.coalesce(c * k, F.lit(0.0))
    df = df.withColumns({
        "score_volume": X.steps(rv, [(2.5, 100.0), (1.5, 80.0), (1.0, 60.0), (0.8, 40.0)], 20.0, 0.0),
        "score_momentum": X.rounded(X.clamp(_add(F.lit(50.0), some(c1, 250.0), some(c5, 180.0), some(c20, 90.0), _if(c1 > 0.15, -15), _if(c5 > 0.35, -15), _if(c20 < -0.25, -15)))),
        "score_liquidity": X.rounded(X.clamp(
            X.steps(X.real("avg_volume_50d"), [(1e7, 100.0), (3e6, 85.0), (1e6, 70.0), (3e5, 55.0)], 20.0, 0.0) * 0.55
            + X.steps(X.real("market_cap"), [(1e11, 100.0), (1e10, 85.0), (1e9, 70.0), (1e8, 50.0)], 20.0, 0.0) * 0.45)),
        "score_context": X.rounded(X.clamp(_add(F.lit(40.0), _if(F.col("above_ma20"), 20), _if(F.col("above_ma50"), 20), F.when(high >= -0.05, 20.0).when(high >= -0.15, 10.0).when(high < -0.40, -10.0).otherwise(0.0)))),
        "score_risk": X.rounded(X.clamp(_add(F.lit(25.0), _if(F.abs(c1) > 0.08, 20), _if(F.abs(c5) > 0.18, 20), _if(rv > 3, 20), _if(rv < 0.5, 10)))),
        "score_confidence": X.rounded(X.clamp(quality - F.when(passes, 0.0).otherwise(30.0))),
        "score_catalyst": F.lit(0.0), "score_fundamental": F.lit(50.0), "score_asymmetry": F.lit(50.0), "score_dilution": F.lit(50.0),
    })
    v, m, q, x, risk, sure = (F.col(f"score_{c}") for c in ("volume", "momentum", "liquidity", "context", "risk", "confidence"))
    raw = _add(v * 0.25, m * 0.25, q * 0.20, x * 0.15, F.col("score_fundamental") * 0.10, F.col("score_asymmetry") * 0.05)
    penalty = _add(F.when(passes, 0.0).otherwise(35.0), _if(sure < 60, 20), _if(risk > 70, 10))
    adjusted = X.clamp(raw - penalty)
    final = X.clamp(adjusted * 0.75 + sure * 0.25)
    category = first_of([
        ("excluded", ~passes), ("low_confidence", sure < 60), ("high_risk_review", risk >= 85), ("high_priority_research", final >= 80),
        ("medium_priority_research", final >= 65), ("watchlist", final >= 50),
    ], "low_priority")
    reason = X.listed(
        F.when(v >= 70, F.lit("strong_relative_volume")), F.when(m >= 70, F.lit("positive_momentum")), F.when(q >= 75, F.lit("good_liquidity")),
        F.when(x >= 70, F.lit("constructive_price_context")), F.when(risk >= 70, F.lit("elevated_risk")), F.when(sure >= 85, F.lit("high_data_confidence")),
    )
    fields = ("price", "previous_close", "volume", "avg_volume_50d", "relative_volume", "change_1d", "change_5d", "change_20d", "ma20", "ma50", "market_cap", "data_quality_score")
    return df.withColumns({
        "score_raw": X.rounded(raw), "penalty_total": penalty, "score_adjusted": X.rounded(adjusted), "score_priority": X.rounded(final), "category_final": category,
        "opportunity_phase": F.lit("quant_screening"), "veto_applied": ~passes, "veto_reason": F.when(passes, F.lit("")).otherwise(F.lit("failed_basic_filters")),
        "reason_to_pass_quant": F.when(reason == "", F.lit("no_strong_quant_signal")).otherwise(reason),
        "missing_key_data_quant": X.listed(*[F.when(missing(c), F.lit(c)) for c in fields]),
    })


def priority_companies(df: DataFrame, least: float = 50.0, excluded: bool = False, key: str = "ticker") -> DataFrame:
    """P15, T1."""
    out = df.where(F.col("score_priority") >= least)
    out = out if excluded else out.where("passes_basic_filters")
    return out.orderBy(F.desc("score_priority"), F.desc("score_confidence"), key)


def score_summary(df: DataFrame) -> DataFrame:
    """A10."""
    count = lambda v: F.count(F.when(F.col("category_final") == v, 1)).alias(v)
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count("score_priority").alias("scored_companies"), F.avg("score_priority").alias("avg_score_priority"), F.max("score_priority").alias("max_score_priority"),
                  *map(count, ("high_priority_research", "medium_priority_research", "watchlist", "low_priority")))


# ---- the local chain: fallback merge, local score, explanation, combined score

PROVIDER_COLUMNS = ("regular_market_price", "market_cap", "volume", "average_volume", "relative_volume", "change_1d", "change_5d", "change_20d")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def provider_fallback(universe: DataFrame, manual: DataFrame, cache: DataFrame, order: str = "input_ordinal", blocked: bool = False) -> DataFrame:
    """Market data by hand if there are any (percent units), else from the cache (ratios), else none; then the fallback score.

    ``universe``: ticker, name, exchange, country, sector, industry and ``order`` (1 is the first row).  Of rows with one
    ticker the first counts, in all three tables.  ``blocked``: the manual table is not used.
    """
    base = first_per_key(universe.withColumn("ticker", X.ticker("ticker")).where("ticker <> ''"), "ticker", order)
    hand = first_per_key(manual.withColumn("ticker", X.ticker("ticker")).where(F.lit(not blocked)), "ticker", order)
    price, volume, average = X.real("price"), X.real("volume"), X.real("average_volume")
    hand = hand.select(
        "ticker", F.lit(True).alias("by_hand"),
        F.struct(
            F.when(price != 0, price).alias("regular_market_price"), X.real("market_cap").alias("market_cap"), volume.alias("volume"), average.alias("average_volume"),
            F.when((volume != 0) & (average != 0), X.rounded(volume / average)).alias("relative_volume"), *[X.percent_to_ratio(X.real(f"{c}_pct")).alias(c) for c in ("change_1d", "change_5d", "change_20d")],
        ).alias("m"),
    )
    kept = first_per_key(cache.withColumn("ticker", X.ticker("ticker")), "ticker", order).where(X.real("regular_market_price").isNotNull())
    kept = kept.select("ticker", F.lit(True).alias("cached"), F.struct(*[X.real(c).alias(c) for c in PROVIDER_COLUMNS]).alias("y"))
    rows = base.join(hand, "ticker", "left").join(kept, "ticker", "left")
    data = F.when(F.col("by_hand"), F.col("m")).otherwise(F.col("y"))
    label = lambda a, b, c: F.when(F.col("by_hand"), F.lit(a)).when(F.col("cached"), F.lit(b)).otherwise(F.lit(c))
    out = rows.withColumn("data", data).select(
        *[c for c in base.columns], *[F.col(f"data.{c}").alias(c) for c in PROVIDER_COLUMNS],
        label("MARKET_DATA_SCORE_MANUAL", "MARKET_DATA_SCORE_YFINANCE", "METADATA_SCORE_FALLBACK").alias("stage3_status"),
        label("manual_market_data.csv", "yfinance_cache", "metadata_fallback").alias("market_data_provider"),
        label("", "", "No usable market data").alias("error"),
    )
    return out.withColumn("fallback_score", fallback_score(F.col(order)))


def fallback_score(position: Column) -> Column:
    """K13; ``position`` is that of the raw row, from 1."""
    price, cap, volume, c20 = (X.real(c) for c in ("regular_market_price", "market_cap", "volume", "change_20d"))
    return X.rounded(X.clamp(_add(
        F.lit(70.0), _if(price != 0, 8, -10), F.when(cap > 1e9, 7.0).when(cap != 0, 3.0).otherwise(-4.0), F.when(volume > 100_000, 5.0).when(volume != 0, 2.0).otherwise(-3.0),
        F.when(c20.isNull(), 0.0).when((c20 * 100.0 >= -25) & (c20 * 100.0 <= 40), 3.0).otherwise(-4.0), F.greatest(F.lit(0.0), 5.0 - position * 0.1),
    )))


def local_score(df: DataFrame) -> DataFrame:
    """K8: six components, total, category.  Zero counts as missing for price, cap, volume and relative volume."""
    price, cap, volume, rv = (X.real(c) for c in ("regular_market_price", "market_cap", "volume", "relative_volume"))
    changes = [X.real(c) for c in ("change_1d", "change_5d", "change_20d")]
    given = lambda c: F.coalesce(c != 0, F.lit(False))
    filled = _add(*[_if(X.text(c) != "", 1) for c in ("ticker", "company_name", "exchange", "country", "sector", "industry")])
    pct = [c * 100.0 for c in changes]
    average = X.mean_present(*pct)
    extreme = reduce(lambda a, b: a | b, [F.coalesce(F.abs(p) > 50, F.lit(False)) for p in pct])
    status, error = X.text("stage3_status"), X.text("error")
    fallback = status == "METADATA_SCORE_FALLBACK"
    df = df.withColumns({
        "metadata_component_score": X.rounded(100.0 * filled / 6.0),
        "market_data_component_score": X.rounded(X.clamp(_add(_if(given(price), 25), _if(given(cap), 25), _if(given(volume), 20), _if(given(rv), 10), _if(changes[0].isNotNull(), 5), _if(changes[1].isNotNull(), 7.5), _if(changes[2].isNotNull(), 7.5)))),
        "liquidity_component_score": X.rounded(X.clamp(_add(F.lit(50.0), X.steps(volume, [(1e6, 25.0), (1e5, 15.0)], -10.0, -25.0), X.steps(cap, [(1e10, 25.0), (1e9, 15.0)], 0.0, -15.0)))),
        "momentum_component_score": F.when(average.isNull(), 50.0).otherwise(X.rounded(X.clamp(_add(
            F.lit(60.0), F.when((average >= -10) & (average <= 15), 20.0).when((average >= -25) & (average <= 35), 5.0).otherwise(-20.0), _if(extreme, -25))))),
        "data_quality_component_score": X.rounded(X.clamp(_add(
            F.lit(70.0), F.when(status == "MARKET_DATA_SCORE_MANUAL", 20.0).when(status == "MARKET_DATA_SCORE_YFINANCE", 15.0).when(fallback, -25.0).when(status.startswith("MARKET_DATA"), 5.0).otherwise(0.0),
            _if(X.text("market_data_provider") == "manual_market_data.csv", 5), _if(error != "", -20)))),
        "penalty_score": X.rounded(X.clamp(_add(
            _if(given(price), 0, 12), _if(cap.isNull(), 8), _if(volume.isNull(), 8), *[_if(F.abs(p) > 50, 8) for p in pct], _if(fallback, 15), _if(error != "", 10)), 0.0, 60.0)),
    })
    parts = [F.col(f"{c}_score") * w for c, w in (("metadata_component", 0.15), ("market_data_component", 0.25), ("liquidity_component", 0.20), ("momentum_component", 0.15), ("data_quality_component", 0.25))]
    total = X.rounded(X.clamp(_add(*parts) - F.col("penalty_score") * 0.25))
    return df.withColumn("local_score_v0", total).withColumn("local_score_category", category4("local_score_v0", "local_score"))


def category4(c: str, prefix: str) -> Column:
    return first_of([(f"{prefix}_high", F.col(c) >= 85), (f"{prefix}_medium", F.col(c) >= 70), (f"{prefix}_watch", F.col(c) >= 55)], f"{prefix}_low")


def explain(df: DataFrame) -> DataFrame:
    """Positive, negative, missing and review factors and badges of a locally scored row; fixed texts, distinct, in order."""
    score, market, liquid, momentum, quality, penalty = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("local_score_v0", "market_data_component_score", "liquidity_component_score", "momentum_component_score", "data_quality_component_score", "penalty_score"))
    fallback, error, manual = X.text("stage3_status") == "METADATA_SCORE_FALLBACK", X.text("error") != "", X.text("market_data_provider") == "manual_market_data.csv"
    say = lambda *cases: F.filter(F.array(*[F.when(w, F.lit(t)) for t, w in cases]), lambda x: x.isNotNull())
    listed = lambda items, default: F.when(F.size(items) == 0, F.array(F.lit(default))).otherwise(items) if default else items
    always = F.lit(True)
    factors = {
        "positive_factors": listed(say(("datos de mercado completos", market >= 85), ("liquidez/tamaño razonables", liquid >= 80), ("momentum sin extremos", momentum >= 75), ("buena calidad/fuente de datos", quality >= 85)), "sin fortalezas destacadas"),
        "negative_factors": listed(say(("datos de mercado incompletos", market < 60), ("liquidez o tamaño débiles", liquid < 55), ("momentum extremo o débil", momentum < 50), ("calidad de datos limitada", quality < 60), ("penalizaciones relevantes", penalty >= 20), ("sin datos de mercado usable", fallback), ("error de proveedor", error)), "sin alertas fuertes"),
        "missing_data_flags": say(*[(t, X.real(c).isNull()) for t, c in (("precio", "regular_market_price"), ("market cap", "market_cap"), ("volumen", "volume"), ("volumen relativo", "relative_volume"), ("1D", "change_1d"), ("5D", "change_5d"), ("20D", "change_20d"))]),
        "review_flags": listed(say(("revisar liquidez/market cap", liquid < 55), ("revisar movimientos recientes", momentum < 50), ("revisar penalizaciones del score", penalty >= 20), ("añadir market data manual", fallback), ("verificar fecha/fuente manual", manual), ("revisar error proveedor", error)), "revisión estándar"),
        "explainability_badges": say(("alta prioridad local", score >= 85), ("prioridad media local", (score >= 70) & (score < 85)), ("revisión baja", score < 70), ("datos completos", market >= 85), ("liquidez OK", liquid >= 80), ("momentum estable", momentum >= 75), ("fallback", fallback), ("manual data", manual)),
    }
    del always
    first3 = lambda c: F.array_join(F.slice(factors[c], 1, 3), ", ")
    summary = F.concat(F.lit("Score "), F.format_number(score, 2), F.lit(": sube por "), first3("positive_factors"), F.lit("; vigilar "), first3("negative_factors"), F.lit("."))
    return df.withColumns({c: X.joined(e) for c, e in factors.items()} | {"explainability_summary": summary})


def granular_fundamentals() -> Column:
    """K10, from the columns of the fundamentals table; missing counts as 0."""
    g = {c: F.coalesce(X.real(c), F.lit(0.0)) for c in ("revenue", "revenue_growth_yoy", "gross_margin", "operating_margin", "net_margin", "free_cash_flow", "total_cash", "total_debt")}
    margin = lambda c, best: X.clamp(g[c] / best * 100.0)
    cover = g["total_cash"] / F.nullif(g["total_debt"], F.lit(0.0))
    return X.rounded(X.clamp(_add(
        X.steps(g["revenue"], [(1e11, 100.0), (5e10, 90.0), (2.5e10, 80.0), (1e10, 70.0), (5e9, 60.0)], 45.0) * 0.15, X.clamp(50.0 + g["revenue_growth_yoy"] * 4.0) * 0.20,
        margin("gross_margin", 65.0) * 0.15, margin("operating_margin", 40.0) * 0.15, margin("net_margin", 35.0) * 0.10,
        F.when(g["free_cash_flow"] > 0, X.steps(g["free_cash_flow"], [(5e10, 100.0), (2e10, 90.0), (1e10, 80.0), (5e9, 70.0)], 55.0)).otherwise(30.0) * 0.15,
        F.when(g["total_debt"] <= 0, 100.0).otherwise(X.steps(cover, [(1.5, 100.0), (1.0, 90.0), (0.75, 80.0), (0.5, 70.0)], 55.0)) * 0.10,
    )))


def fundamentals_component() -> Column:
    """K9: the fundamentals score of a joined row that has fundamentals."""
    revenue, growth, gross, operating, net, fcf, cash, debt = (X.real(c) for c in ("revenue", "revenue_growth_yoy", "gross_margin", "operating_margin", "net_margin", "free_cash_flow", "total_cash", "total_debt"))
    balance = F.when(cash.isNull() | debt.isNull(), -3.0).when((debt <= 0) & (cash > 0), 6.0).when(cash >= debt, 6.0).when(debt > cash * 3.0, -8.0).otherwise(1.0)
    return X.rounded(X.clamp(_add(
        F.lit(50.0), F.when(revenue.isNull(), -12.0).when(revenue >= 5e10, 10.0).when(revenue >= 5e9, 6.0).when(revenue > 0, 2.0).otherwise(-10.0),
        X.steps(growth, [(10, 10.0), (3, 6.0), (0, 2.0)], -8.0, -6.0), X.steps(gross, [(60, 10.0), (40, 7.0), (20, 2.0)], -6.0, -5.0), X.steps(operating, [(30, 10.0), (15, 6.0), (0, 1.0)], -10.0, -5.0),
        X.steps(net, [(20, 7.0), (8, 4.0), (0, 0.0)], -8.0, -3.0), F.when(fcf.isNull(), -7.0).when(fcf > 0, 10.0).otherwise(-10.0), balance,
    )))


FUNDAMENTALS = ("revenue", "revenue_growth_yoy", "gross_margin", "operating_margin", "net_margin", "free_cash_flow", "total_cash", "total_debt")


def combined_score(df: DataFrame, fundamentals: DataFrame, previous: str = "local_score_v0", order: str = "input_ordinal", price: str | None = None) -> DataFrame:
    """Components, combined score and ties."""
    return with_ties(combined_components(df, fundamentals, previous, order, price))


COMPONENTS = ("metadata_score_component", "market_data_score_component", "fundamentals_score_component")


def with_ties(rows: DataFrame) -> DataFrame:
    """Whether another row has the same four scores."""
    rows = counted(rows, [F.round(c, 4) for c in ("combined_score_v1", *COMPONENTS)], "__same")
    return rows.withColumn("tie_status", F.when(F.col("__same") > 1, F.lit("EXACT_COMPONENT_TIE")).otherwise(F.lit("NO_TIE"))).drop("__same")


def combined_components(df: DataFrame, fundamentals: DataFrame, previous: str = "local_score_v0", order: str = "input_ordinal", price: str | None = None) -> DataFrame:
    """Components and combined score.  Of fundamentals with one ticker the last row counts.

    ``price``: the price column; the chain before this writes none under the name it looks for, so the default is none.
    The changes are compared with percent bounds as they come, whatever their unit.
    """
    last = fundamentals.withColumn("ticker", X.ticker("ticker", dollars=True)).where("ticker <> ''")
    w = Window.partitionBy("ticker").orderBy(F.desc(order))
    last = last.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("ticker", F.lit(True).alias("__has"), *FUNDAMENTALS)
    rows = df.withColumn("ticker", X.ticker("ticker", dollars=True)).drop(*FUNDAMENTALS).join(last, "ticker", "left")
    base = F.coalesce(X.clamp(X.real(previous)), F.lit(50.0))
    has = F.coalesce(F.col("__has"), F.lit(False))
    cost, cap, volume, rv = X.real(price) if price else F.lit(None).cast("double"), *(X.real(c) for c in ("market_cap", "volume", "relative_volume"))
    momentum = X.mean_present(*[X.real(c) for c in ("change_1d", "change_5d", "change_20d")])
    quality = _add(F.lit(60.0), _if(X.text("sector") != "", 12, -6), _if(X.text("industry") != "", 12, -6), _if(X.text("exchange") != "", 8, -4))
    market = _add(
        F.lit(50.0), _if(cost > 0, 8, -12), F.when(cap > 1e9, 12.0).when(cap.isNull(), -8.0).otherwise(-4.0), F.when(volume > 500_000, 10.0).when(volume.isNull(), -6.0).otherwise(-2.0),
        _if((rv >= 0.3) & (rv <= 3.0), 5), F.when(momentum.isNull(), -4.0).when((momentum >= -5) & (momentum <= 15), 8.0).when((momentum < -10) | (momentum > 30), -8.0).otherwise(2.0),
    )
    rows = rows.withColumns({
        "score_previous": base, "metadata_score_component": X.rounded(X.clamp(quality * 0.45 + base * 0.55)), "market_data_score_component": X.rounded(X.clamp(market * 0.65 + base * 0.35)),
        "fundamentals_score_component": F.when(has, fundamentals_component()).otherwise(35.0), "fundamentals_granular_score": F.when(has, granular_fundamentals()).otherwise(0.0),
        "fundamentals_status": F.when(has, F.lit("OK")).otherwise(F.lit("MISSING")),
    })
    rows = rows.withColumn("combined_score_v1", X.rounded(X.clamp(_add(*[F.col(c) * k for c, k in zip(COMPONENTS, (0.20, 0.35, 0.45), strict=True)]))))
    return rows.withColumns({"combined_score_delta": X.rounded(F.col("combined_score_v1") - base), "combined_category": category4("combined_score_v1", "combined_score")}).drop("__has")


def by_combined(df: DataFrame) -> DataFrame:
    """T4: the ticker descending too."""
    return df.orderBy(F.desc("combined_score_v1"), F.desc("fundamentals_granular_score"), F.desc("ticker"))


def weight_sensitivity(df: DataFrame, scenarios: dict[str, tuple[float, float, float]] = SENSITIVITY) -> DataFrame:
    """Every row under every weighting, with its rank in the scenario."""
    table = F.array(*[F.struct(F.lit(k).alias("scenario"), *[F.lit(x).alias(n) for n, x in zip(("wm", "wd", "wf"), w, strict=True)]) for k, w in scenarios.items()])
    rows = df.withColumn("s", F.explode(table))
    score = F.col("metadata_score_component") * F.col("s.wm") + F.col("market_data_score_component") * F.col("s.wd") + F.col("fundamentals_score_component") * F.col("s.wf")
    return rows.select("ticker", F.col("s.scenario").alias("scenario"), X.rounded(score).alias("scenario_score"))


def scenario_rank(df: DataFrame) -> DataFrame:
    """By counts of scores over ranges, as a scenario has all rows."""
    return ranked(df, ["scenario"], "scenario_score", "scenario_rank")


#: Fixed values of the metadata score.
#: What counts as a major exchange, a developed market and a sector of high signal.
MAJOR = ("NASDAQ", "NYSE", "LSE", "XETRA", "EPA", "TSE", "AMS", "BME", "SWX", "HKEX")
DEVELOPED = ("US", "CA", "GB", "UK", "NL", "DE", "FR", "ES", "IT", "CH", "SE", "DK", "NO", "FI", "JP", "AU", "IE")
HIGH_SIGNAL = ("Technology", "Healthcare", "Industrials", "Financial Services", "Consumer Defensive", "Communication Services", "Semiconductors")


def metadata_score(df: DataFrame, position: str, major: tuple = MAJOR, developed: tuple = DEVELOPED, sectors: tuple = HIGH_SIGNAL) -> DataFrame:
    """The score of listing metadata and its category; ``position`` is that of the row among the deduplicated, from 1."""
    there = [X.text(c) != "" for c in ("ticker", "exchange", "country", "sector", "industry")] + [(X.text("name") != "") | (X.text("ticker") != "")]
    complete = X.rounded(100.0 * _add(*[_if(c, 1) for c in there]) / 6.0)
    known = lambda c, good, hit, miss: F.when(c.isin(*good) if good else F.lit(False), hit).when(c != "", miss).otherwise(20.0)
    score = _add(0.35 * complete, 0.20 * known(F.upper(X.text("exchange")), major, 100.0, 60.0), 0.20 * known(F.upper(X.text("country")), developed, 100.0, 60.0), 0.15 * known(X.text("sector"), sectors, 85.0, 65.0),
                 0.05 * _if(X.text("industry") != "", 80, 20), 0.05 * F.greatest(F.lit(40.0), 100.0 - (F.col(position) - 1) * 2.0))
    out = df.withColumns({"metadata_completeness_score": complete, "metadata_score": X.rounded(score)})
    s = F.col("metadata_score")
    return out.withColumn("metadata_category", F.when(s >= 85, F.lit("metadata_high")).when(s >= 65, F.lit("metadata_medium")).otherwise(F.lit("metadata_low")))


def order_score(position: Column) -> Column:
    """Of the raw row's position, from 1."""
    return F.greatest(F.lit(1.0), 100.0 - (position - 1))


def adapter_score(position: Column) -> Column:
    """K13, the adapter's: percent changes."""
    price, cap, volume, c20 = (X.real(c) for c in ("regular_market_price", "market_cap", "volume", "change_20d"))
    return X.rounded(X.clamp(_add(F.lit(75.0), _if(price != 0, 6, -10), F.when(cap > 1e9, 6.0).when(cap != 0, 2.0).otherwise(-4.0), F.when(volume > 100_000, 4.0).when(volume != 0, 1.0).otherwise(-3.0),
                                  F.when(c20.isNull(), 0.0).when((c20 >= -25) & (c20 <= 40), 2.0).otherwise(-3.0), F.greatest(F.lit(0.0), 5.0 - position * 0.1))))


def completeness(fields: list[str], partial: dict[str, float] | None = None) -> Column:
    """Percent of ``fields`` that are there; those of ``partial`` count so much."""
    weight = lambda c: (partial or {}).get(c, 1.0)
    there = lambda c: F.coalesce(~F.col(c).cast("string").isin("", "None"), F.lit(False))
    return X.rounded(100.0 * _add(*[_if(there(c), weight(c)) for c in fields]) / sum(map(weight, fields)))


def readiness(blockers: Column, warnings: Column, per_blocker: float = 20.0, per_warning: float = 5.0) -> Column:
    """K18."""
    return F.greatest(F.lit(0.0), 100.0 - blockers * per_blocker - warnings * per_warning)


def request_cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """K22."""
    part = lambda c, r: F.greatest(c, F.lit(0)) / 1e6 * r
    return X.rounded(part(tokens_in, rate_in) + part(tokens_out, rate_out), 6)


def _listed(xs: list[tuple[str, Column]], none: str) -> Column:
    said = F.concat_ws(", ", *[F.when(c, F.lit(t)) for t, c in xs])
    return F.when(said == "", F.lit(none)).otherwise(said)


def local_reason(df: DataFrame) -> Column:
    """the sentence beside a local score; fixed texts."""
    strong = [("datos de mercado completos", F.col("market_data_component_score") >= 80), ("liquidez/tamaño razonables", F.col("liquidity_component_score") >= 80), ("momentum sin extremos", F.col("momentum_component_score") >= 75), ("buena calidad/fuente de datos", F.col("data_quality_component_score") >= 85)]
    weak = [("penalizaciones por datos faltantes o extremos", F.col("penalty_score") >= 20), ("sin market data usable", X.text("stage3_status") == "METADATA_SCORE_FALLBACK"), ("errores de proveedor", X.text("error") != "")]
    return F.concat(F.format_string("LOCAL_SCORE_V0 %.2f: sube por ", df["local_score_v0"]), _listed(strong, "sin fortalezas destacadas"), F.lit("; revisar por "), _listed(weak, "sin alertas fuertes"), F.lit(". No es recomendación financiera."))


def combined_summary(total: str, metadata: str, market: str, fundamentals: str, positives: Column, negatives: Column) -> Column:
    """the sentence beside a combined score, with the first four of each list; fixed texts."""
    first = lambda xs, said, none: F.when(F.size(xs) > 0, F.concat(F.lit(said), F.array_join(F.slice(xs, 1, 4), ", "))).otherwise(F.lit(none))
    text = lambda c: F.col(c).cast("string")
    return F.concat(
        F.lit("COMBINED_SCORE_V1 "), text(total), F.lit(": metadata "), text(metadata), F.lit(", market data "), text(market), F.lit(", fundamentales "), text(fundamentals), F.lit(". "),
        first(positives, "Sube por ", "Sin factores positivos fuertes"), F.lit("; "), first(negatives, "vigilar ", "sin alertas fuertes"), F.lit(". No es recomendación financiera."),
    )
