"""Research memos: module scores, verdicts, red flags, row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.rules import first_of
from .stages import with_missing

# Module -> (gaps that make it insufficient, {metric: (better when high or low, ladder, last)}).
HIGH, LOW = "high", "low"
MODULES: dict[str, tuple[int, dict[str, tuple]]] = {
    "financial_health": (6, {
        "revenue_growth": (HIGH, [(25, 90), (10, 75), (0, 55)], 35), "gross_margin": (HIGH, [(65, 90), (40, 75), (20, 55)], 35), "operating_margin": (HIGH, [(25, 90), (10, 75), (0, 55)], 35),
        "net_margin": (HIGH, [(20, 90), (8, 75), (0, 55)], 35), "roe": (HIGH, [(25, 90), (10, 75), (0, 55)], 35), "roa": (HIGH, [(12, 90), (5, 75), (0, 55)], 35),
        "debt_to_equity": (LOW, [(50, 85), (120, 65), (250, 45)], 25), "current_ratio": (HIGH, [(2.5, 90), (1.5, 75), (1.0, 55)], 35), "free_cash_flow": (HIGH, [(10, 90), (1, 75), (0, 55)], 35),
    }),
    "valuation_analysis": (4, {
        "pe": ("multiple", [(12, 85), (25, 70), (45, 45)], 25), "price_to_sales": ("multiple", [(3, 85), (8, 70), (15, 45)], 25), "price_to_book": ("multiple", [(2, 85), (5, 70), (10, 45)], 25),
        "ev_to_ebitda": ("multiple", [(8, 85), (16, 70), (30, 45)], 25), "fcf_yield": (HIGH, [(8, 85), (4, 70), (0, 45)], 25),
    }),
    "risk_analysis": (5, {
        "beta": (LOW, [(0.9, 85), (1.3, 65), (1.8, 45)], 25), "volatility": (LOW, [(25, 85), (45, 65), (70, 40)], 20), "max_drawdown": (HIGH, [(-20, 85), (-40, 65), (-60, 40)], 20),
        "debt_to_equity": (LOW, [(50, 85), (120, 65), (250, 40)], 20), "short_ratio": (LOW, [(3, 80), (7, 60)], 35), "current_ratio": (HIGH, [(1.5, 80), (1.0, 60)], 30), "market_cap": (HIGH, [(2e9, 75), (3e8, 55)], 35),
    }),
    "moat_analysis": (4, {
        "gross_margin": (HIGH, [(65, 85), (40, 70), (20, 45)], 25), "operating_margin": (HIGH, [(25, 85), (12, 70), (0, 45)], 25), "roe": (HIGH, [(25, 85), (12, 70), (0, 45)], 25),
        "roic": (HIGH, [(18, 85), (10, 70), (0, 45)], 25), "revenue_growth": (HIGH, [(10, 75), (0, 55)], 30),
    }),
    "growth_analysis": (4, {c: (HIGH, [(30, 90), (15, 75), (0, 55)], 30) for c in ("revenue_growth", "earnings_growth", "ebitda_growth", "free_cash_flow_growth", "analyst_growth")}),
    "institutional_view": (3, {
        "institutional_ownership": ("between", (20, 85, 80), (60, 45)), "insider_ownership": ("between", (2, 35, 75), (55, 45)),
        "analyst_count": (HIGH, [(10, 80), (4, 65)], 45), "recommendation_mean": (LOW, [(2.0, 80), (3.0, 60)], 35),
    }),
    "earnings_analysis": (3, {
        "eps_growth": (HIGH, [(20, 85), (5, 70), (0, 45)], 25), "revenue_growth": (HIGH, [(15, 80), (5, 65), (0, 45)], 25), "earnings_surprise": (HIGH, [(5, 80), (0, 60)], 35),
    }),
}
SCORED = ("financial_health", "valuation_analysis", "risk_analysis", "moat_analysis", "growth_analysis", "institutional_view")
METRICS = sorted({m for _, ms in MODULES.values() for m in ms})


def _metric(name: str, spec: tuple) -> Column:
    how, ladder, last = spec
    x = X.real(name)
    floats = lambda rungs: [(float(a), float(b)) for a, b in rungs]
    if how == HIGH:
        return X.steps(x, floats(ladder), float(last))
    if how == LOW:
        return X.steps_down(x, floats(ladder), float(last))
    if how == "multiple":
        return F.when(x > 0, X.steps_down(x, floats(ladder), float(last)))
    low, high, good = ladder
    return F.when((x >= low) & (x <= high), float(good)).when(x < low, float(last[0])).when(x > high, float(last[1]))


def memo_scores(df: DataFrame) -> DataFrame:
    """A score and status for each module, the memo's score, gaps, status, confidence and verdict."""
    df = with_missing(df, dict.fromkeys(METRICS, "double") | {"next_earnings_date": "string"})
    scores, gaps, status = {}, [], {}
    for module, (limit, metrics) in MODULES.items():
        parts = {m: _metric(m, spec) for m, spec in metrics.items()}
        missing = [F.when(p.isNull(), F.lit(f"{module}.{m}")) for m, p in parts.items()]
        n = sum((p.isNull().cast("int") for p in parts.values()), F.lit(0))
        if module == "earnings_analysis":
            missing.append(F.when(X.is_blank("next_earnings_date"), F.lit(f"{module}.next_earnings_date")))
            n = n + X.is_blank("next_earnings_date").cast("int")
        score = X.rounded(X.mean_present(*parts.values()))
        scores[f"{module}_score"] = score
        status[f"{module}_status"] = F.when(F.col(f"{module}_score").isNull() | (n >= limit), F.lit("data_insufficient")).otherwise(F.lit("ok"))
        gaps += missing
    df = df.withColumns(scores).withColumns(status)
    df = df.withColumn("data_gaps", F.array_sort(F.array_distinct(F.filter(F.array(*gaps), lambda g: g.isNotNull()))))
    df = df.withColumn("deterministic_score", X.rounded(X.mean_present(*[F.col(f"{m}_score") for m in SCORED])))
    risk = F.col("risk_analysis_score")
    total, n = F.col("deterministic_score"), F.size("data_gaps")
    return df.withColumns({
        "risk_level": F.when(risk.isNull(), F.lit(None).cast("string")).when(risk >= 75, F.lit("low")).when(risk >= 55, F.lit("moderate")).otherwise(F.lit("high")),
        "gap_count": n, "memo_status": F.when(total.isNull() | (n >= 18), F.lit("data_insufficient")).otherwise(F.lit("deterministic_complete")),
        "confidence": first_of([("low", total.isNull()), ("high", n <= 5), ("medium", n <= 10)], "low"),
        "final_verdict": first_of([("watchlist_only", total.isNull()), ("research_candidate", (total >= 70) & (risk.isNull() | (risk >= 55))), ("high_risk_or_weak_data", (total < 45) | F.coalesce(risk < 55, F.lit(False)))], "watchlist_only"),
    })


def normalized_verdict(verdict: Column, status: Column, gaps: Column) -> Column:
    """``gaps`` is an array; its words come before the verdict's."""
    v = F.lower(F.coalesce(F.nullif(X.text(verdict), F.lit("")), X.text(status)))
    thin = F.exists(gaps, lambda g: F.lower(g).contains("insufficient") | F.lower(g).contains("missing"))
    return first_of([
        ("NEEDS_MORE_DATA", thin | v.isin("data_insufficient", "insufficient_data", "needs_more_data", "need_more_data")), ("REJECT", v.isin("avoid", "reject", "rejected", "not_candidate", "weak", "red_flag")),
        ("WATCHLIST", v.isin("watchlist", "watchlist_only", "research_candidate", "strong_research_candidate", "candidate", "ok", "active")),
    ], "NEEDS_MORE_DATA")


def enforced_verdict(verdict: Column, has_high: Column) -> Column:
    """C22."""
    v = F.upper(F.coalesce(verdict, F.lit("NEEDS_MORE_DATA")))
    return first_of([("NEEDS_MORE_DATA", has_high), ("REJECT", v == "REJECT"), ("WATCHLIST", v == "WATCHLIST")], "NEEDS_MORE_DATA")


SEVERITY = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
# Category, metric, (code, severity, threshold) gravest first, and which way is bad.
BY_METRIC = [
    ("debt", "net_debt_to_ebitda", ">", [("DEBT_NET_DEBT_EBITDA_GT_5", "HIGH", 5.0), ("DEBT_NET_DEBT_EBITDA_GT_3", "MEDIUM", 3.0)]),
    ("margins", "operating_margin", "<", [("OPERATING_MARGIN_LT_NEG_20", "HIGH", -0.20), ("OPERATING_MARGIN_NEGATIVE", "MEDIUM", 0.0)]),
    ("fcf", "fcf_margin", "<", [("FCF_MARGIN_LT_NEG_10", "HIGH", -0.10), ("FCF_MARGIN_NEGATIVE", "MEDIUM", 0.0)]),
    ("dilution", "shares_dilution_3y", ">", [("DILUTION_3Y_GT_30", "HIGH", 0.30), ("DILUTION_3Y_GT_15", "MEDIUM", 0.15)]),
    ("data_quality", "data_quality_score", "<", [("DATA_QUALITY_LOW", "HIGH", 3.5), ("DATA_QUALITY_MEDIUM_LOW", "MEDIUM", 5.0)]),
    ("risk", "risk_score", ">", [("RISK_SCORE_GT_8_5", "HIGH", 8.5), ("RISK_SCORE_GT_7", "MEDIUM", 7.0)]),
    ("valuation", "valuation_score", "<", [("VALUATION_SCORE_LOW", "MEDIUM", 3.0)]),
    ("growth", "growth_score", "<", [("GROWTH_SCORE_LOW", "MEDIUM", 3.0)]),
]
BY_TOKEN = [
    ("DEBT", "debt", "HIGH", "DEBT_REASON_PRESENT"), ("OPERATING_MARGIN", "margins", "HIGH", "OPERATING_MARGIN_REASON_PRESENT"), ("FCF_MARGIN", "fcf", "HIGH", "FCF_REASON_PRESENT"),
    ("DILUTION", "dilution", "HIGH", "DILUTION_REASON_PRESENT"), ("DATA_QUALITY", "data_quality", "HIGH", "DATA_QUALITY_REASON_PRESENT"), ("DATA_COMPLETENESS", "data_quality", "MEDIUM", "DATA_COMPLETENESS_REASON_PRESENT"),
    ("RISK_SCORE", "risk", "HIGH", "RISK_SCORE_REASON_PRESENT"), ("FINAL_SCORE", "risk", "MEDIUM", "FINAL_SCORE_REASON_PRESENT"), ("MARKET_CAP", "source_quality", "MEDIUM", "MARKET_CAP_REASON_PRESENT"),
    ("DOLLAR_VOLUME", "source_quality", "MEDIUM", "DOLLAR_VOLUME_REASON_PRESENT"),
]


def red_flags(df: DataFrame, text_columns: list[str]) -> DataFrame:
    """``df`` with red_flags, an array of distinct flags, gravest first, then by category and code.

    ``text_columns``: where reason tokens are looked for.  Stage statuses, metrics and tokens each give flags.
    """
    kinds = dict.fromkeys([m for _, m, _, _ in BY_METRIC], "double") | dict.fromkeys([f"stage{i}_status" for i in (1, 2, 3)], "string")
    df = with_missing(df, kinds)
    made = lambda when, category, severity, code, evidence, source: F.when(when, F.struct(
        F.lit(-SEVERITY.index(severity)).alias("order"), F.lit(category).alias("category"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), evidence.alias("evidence"), F.lit(source).alias("source")))
    flags = []
    for i in (1, 2, 3):
        s = F.upper(X.text(f"stage{i}_status"))
        flags += [made(s == v, "risk", sev, f"STAGE{i}_{v}", F.concat(F.lit("status="), s), "stage_status") for v, sev in (("REJECTED", "HIGH"), ("WATCHLIST", "MEDIUM"))]
    for category, metric, bad, ladder in BY_METRIC:
        x, graver = X.real(metric), F.lit(False)
        for code, severity, t in ladder:
            now = x > t if bad == ">" else x < t
            flags.append(made(now & ~graver, category, severity, code, F.concat(F.lit(f"{metric}="), x.cast("string")), "metric"))
            graver = F.coalesce(now, F.lit(False))
    blob = X.row_text(*text_columns)
    flags += [made(blob.contains(t), category, severity, code, F.lit(f"token={t}"), "reason_text") for t, category, severity, code in BY_TOKEN]
    return df.withColumn("red_flags", F.array_sort(F.array_distinct(F.filter(F.array(*flags), lambda f: f.isNotNull()))))


def red_flag_rows(df: DataFrame, key: str = "ticker") -> DataFrame:
    return df.select(key, F.explode("red_flags").alias("f")).select(key, *[F.col(f"f.{c}").alias(c) for c in ("category", "severity", "code", "source")])


def red_flag_summary(df: DataFrame, key: str = "ticker") -> DataFrame:
    """Counts by severity, the gravest; a row for each row of ``df``."""
    count = lambda s: F.size(F.filter("red_flags", lambda f: f["severity"] == s)).cast("long")
    out = df.select(key, F.size("red_flags").cast("long").alias("red_flag_count"), *[count(s).alias(f"{s.lower()}_count") for s in SEVERITY])
    gravest = first_of([(s, F.col(f"{s.lower()}_count") > 0) for s in reversed(SEVERITY)], "LOW")
    return out.withColumns({"max_severity": gravest, "has_high_or_critical": (F.col("high_count") + F.col("critical_count")) > 0})


def issues(*cases: tuple[Column, str, str, str]) -> Column:
    """An array of (level, field, message) for the cases that hold."""
    made = [F.when(when, F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), F.lit(message).alias("message"))) for when, level, field, message in cases]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


FUNDAMENTAL_NUMBERS = ("revenue", "revenue_growth_yoy", "gross_margin", "operating_margin", "net_margin", "free_cash_flow", "total_cash", "total_debt", "shares_diluted")


#: The columns that each file must have.
FUNDAMENTAL_COLUMNS = ("ticker", "period", "period_end", *FUNDAMENTAL_NUMBERS[:8], "shares_diluted", "currency", "source_note")
UNIVERSE_COLUMNS = ("ticker", "name", "exchange", "country", "sector", "industry")
LISTING_COLUMNS = ("ticker", "company_name", "exchange", "country", "source_provider", "source_file", "instrument_type", "instrument_scope", "classification_confidence", "classification_reason")
#: What a listing may say.
LISTING_WORDS = {"instrument_scope": ("IN_SCOPE", "IN_SCOPE_ADR"), "instrument_type": ("COMMON_STOCK", "ADR"), "classification_confidence": ("HIGH", "MEDIUM", "LOW")}

ISSUE = "level string, row_number long, ticker string, field string, message string"


def repeats(df: DataFrame, key: Column, order: str) -> Column:
    """Whether an earlier row has the same key; blank keys, however many, are nobody's repeats and no window's."""
    from pyspark.sql import Window

    own = F.when(key != "", key).otherwise(F.concat(F.lit(" "), F.col(order).cast("string")))
    return F.row_number().over(Window.partitionBy(own).orderBy(order)) > 1


def file_issues(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """What is wrong with a file as a whole, as ``ISSUE``: no rows, columns that are missing.  At most a row for each column."""
    missing = [c for c in required if c not in df.columns]
    spark = df.sparkSession
    columns = spark.createDataFrame([("ERROR", None, "", c, f"Missing required column: {c}") for c in missing], ISSUE)
    empty = df.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("ERROR").alias("level"), F.lit(None).cast("long").alias("row_number"), F.lit("").alias("ticker"), F.lit("file").alias("field"), F.lit("file is empty or unreadable").alias("message"))
    return columns.unionByName(empty)


def all_issues(df: DataFrame, marked: DataFrame | None, required: tuple[str, ...], order: str) -> DataFrame:
    """File-level issues and those of rows (``marked`` has ``issues``) in one channel; ``order`` is a row's number."""
    whole = file_issues(df, required)
    if marked is None:
        return whole
    rows = marked.select(F.col(order).cast("long").alias("row_number"), X.ticker("ticker").alias("ticker"), F.explode("issues").alias("i"))
    return whole.unionByName(rows.select("i.level", "row_number", "ticker", "i.field", "i.message"))


def validate_fundamentals(df: DataFrame, universe: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """``df`` with issues and valid (no ERROR); a ticker's later rows are duplicates, an empty universe knows all."""
    known = universe.select(X.ticker("ticker").alias("__t")).where("__t <> ''").distinct()
    some = known.limit(1).agg(F.count(F.lit(1)).alias("__some"))  # one row
    rows = df.withColumns({"__t": X.ticker("ticker"), "__again": repeats(df, X.ticker("ticker"), order)}).join(known.withColumn("__in", F.lit(True)), "__t", "left").crossJoin(F.broadcast(some))
    named = F.col("__t") != ""
    cases = [(~named, "ERROR", "ticker", "Empty ticker"), (named & F.col("__again"), "ERROR", "ticker", "Duplicate ticker"), ((F.col("__some") > 0) & named & F.col("__in").isNull(), "WARNING", "ticker", "Ticker not present in real_universe.csv"),
             (~F.upper(X.text("period")).isin("TTM", "FY", "MRQ", "ANNUAL", "QUARTER"), "WARNING", "period", "Unexpected period value")]
    for c in FUNDAMENTAL_NUMBERS:
        x = X.number(c)
        cases.append((x.isNull(), "ERROR", c, f"Non numeric or empty value: {c}"))
        if c in ("revenue", "shares_diluted"):
            cases.append((x <= 0, "ERROR", c, f"{c} must be positive"))
        if c in ("gross_margin", "operating_margin", "net_margin"):
            cases.append((F.abs(x) > 100, "WARNING", c, "Suspicious margin percentage"))
    rows = rows.withColumn("issues", issues(*cases)).drop("__t", "__again", "__in", "__some")
    return rows.withColumn("valid", ~F.exists("issues", lambda i: i["level"] == "ERROR"))


def fundamentals_issues(df: DataFrame, universe: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """All issues of a fundamentals file; rows are looked at only if no column is missing."""
    ready = set(FUNDAMENTAL_COLUMNS) <= set(df.columns)
    return all_issues(df, validate_fundamentals(df, universe, order) if ready else None, FUNDAMENTAL_COLUMNS, order)


def validate_universe(df: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """``df`` with issues; a row without a ticker of the right shape has no other issue, nor is it another's repeat."""
    from .universe import looks_like_ticker

    t = X.ticker("ticker")
    fine = (t != "") & looks_like_ticker(t)
    rows = df.withColumn("__again", repeats(df, F.when(fine, t).otherwise(F.lit("")), order))
    cases = [(t == "", "ERROR", "ticker", "Empty ticker."), ((t != "") & ~fine, "ERROR", "ticker", "Invalid ticker format."), (fine & F.col("__again"), "WARNING", "ticker", "Duplicate ticker.")]
    cases += [(fine & X.is_blank(c), "WARNING", c, f"Empty {c}.") for c in ("exchange", "country") if c in df.columns]
    return rows.withColumn("issues", issues(*cases)).drop("__again")


def universe_issues(df: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """All issues of a universe file."""
    return all_issues(df, validate_universe(df, order) if "ticker" in df.columns else None, UNIVERSE_COLUMNS, order)


def universe_summary(df: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """One row: rows_total, valid_tickers, duplicate_tickers (distinct), empty_tickers, invalid_tickers, status."""
    from .universe import looks_like_ticker

    t = X.ticker("ticker")
    keys = df.groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("n")).withColumn("fine", looks_like_ticker(F.col("t")))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    out = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"), F.count_if("fine").alias("valid_tickers"), F.count_if(F.col("fine") & (F.col("n") > 1)).alias("duplicate_tickers"),
        total(F.col("t") == "").alias("empty_tickers"), total((F.col("t") != "") & ~F.col("fine")).alias("invalid_tickers"),
    )
    missing = F.lit(any(c not in df.columns for c in UNIVERSE_COLUMNS))
    return out.withColumn("status", F.when(missing | (F.col("empty_tickers") > 0) | (F.col("invalid_tickers") > 0), F.lit("ERROR")).when(F.col("duplicate_tickers") > 0, F.lit("WARNING")).otherwise(F.lit("OK")))


MARKET_COLUMNS, PERCENTS, LEGACY_PERCENTS = ("ticker", "price", "market_cap", "volume", "average_volume", "currency", "as_of"), ("change_1d_pct", "change_5d_pct", "change_20d_pct"), ("change_1d", "change_5d", "change_20d")


def market_file_issues(columns: list[str]) -> list[tuple[str, str]]:
    """What is wrong with the columns of a file, as (level, message); rows are looked at only if nothing is."""
    out = [("ERROR", f"Missing base columns: {missing}")] if (missing := [c for c in MARKET_COLUMNS if c not in columns]) else []
    if not set(PERCENTS) <= set(columns) and not set(LEGACY_PERCENTS) <= set(columns):
        out.append(("ERROR", "Missing percent columns. Use change_1d_pct/change_5d_pct/change_20d_pct."))
    return out


def validate_market_rows(df: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """``df`` with issues: numeric fields, percentages beyond 100, repeated tickers; a row without a ticker has no other."""
    from pyspark.sql import Window

    t, named = X.ticker("ticker"), ~X.is_blank("ticker")
    seen = F.row_number().over(Window.partitionBy(F.when(named, t).otherwise(F.concat(F.lit(" "), F.col(order).cast("string")))).orderBy(order)) > 1
    cases = [(~named, "ERROR", "ticker", "Empty ticker"), (named & F.col("__seen"), "WARNING", "ticker", "Duplicate ticker")]
    cases += [(named & ~X.is_blank(c) & X.number(c).isNull(), "ERROR", c, "Non numeric") for c in ("price", "market_cap", "volume", "average_volume")]
    for new, old in zip(PERCENTS, LEGACY_PERCENTS, strict=True):
        c = new if new in df.columns else old
        cases += [(named & ~X.is_blank(c) & X.number(c).isNull(), "ERROR", new, "Non numeric"), (named & (F.abs(X.number(c)) > 100), "WARNING", new, "Suspicious percentage")]
    if set(LEGACY_PERCENTS) <= set(df.columns) and not set(PERCENTS) <= set(df.columns):
        cases.append((named, "WARNING", "change_1d", "Legacy change columns detected"))
    return df.withColumn("__seen", seen).withColumn("issues", issues(*cases)).drop("__seen")


def validate_listing(df: DataFrame, vocabulary: dict[str, tuple[str, ...]] = LISTING_WORDS) -> DataFrame:
    """``df`` with issues: empty fields and values outside their vocabulary, blank ones too."""
    names = {"instrument_scope": "INVALID_SCOPE", "instrument_type": "INVALID_INSTRUMENT_TYPE", "classification_confidence": "INVALID_CONFIDENCE"}
    cases = [(X.is_blank(c), "ERROR", c, f"EMPTY_{c.upper()}") for c in ("ticker", "company_name", "exchange", "country")]
    cases += [(~X.text(c).isin(*words), "ERROR", c, names.get(c, f"INVALID_{c.upper()}")) for c, words in vocabulary.items()]
    return df.withColumn("issues", issues(*cases))


def listing_issues(df: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """All issues of a listing file, and one for each key of exchange and ticker that several rows have."""
    again = df.where(~X.is_blank("ticker") & ~X.is_blank("exchange")).groupBy(X.text("exchange").alias("exchange"), X.ticker("ticker").alias("ticker")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = again.select(F.lit("ERROR").alias("level"), F.lit(None).cast("long").alias("row_number"), "ticker", F.lit("exchange+ticker").alias("field"), F.concat(F.lit("DUPLICATE_KEY "), "exchange", F.lit(" "), F.col("n").cast("string")).alias("message"))
    return all_issues(df, validate_listing(df), LISTING_COLUMNS, order).unionByName(keys)


def issue_rows(df: DataFrame, key: str = "ticker") -> DataFrame:
    return df.select(key, F.explode("issues").alias("i")).select(key, "i.level", "i.field", "i.message")


def special_case_inference(ticker: Column | str, quote_type: Column | str, asset_type: Column | str, sector: Column | str, industry: Column | str, country: Column | str) -> Column:
    """C19."""
    quote, place = F.upper(X.text(quote_type)), X.col(country).cast("string")
    reit = F.upper(X.text(asset_type)).contains("REIT") | F.lower(X.text(sector)).contains("reit") | F.lower(X.text(industry)).contains("reit")
    abroad = X.text(ticker).endswith("Y") & F.coalesce(~place.isin("United States", "USA", "US"), F.lit(False))
    found = F.concat_ws("|", F.when(reit, F.lit("REIT")), F.when(~quote.isin("EQUITY", "ADR", ""), F.concat(F.lit("QUOTE_TYPE_"), quote)), F.when(abroad, F.lit("POSSIBLE_ADR")))
    return F.when(found == "", F.lit("none")).otherwise(found)


def prudence_warning(category: Column, confidence: Column, evidence: Column, limitations: Column) -> Column:
    """C25."""
    return F.lower(X.text(category)).contains("datos insuficientes") | F.coalesce(confidence < 4, F.lit(False)) | F.coalesce(evidence < 4, F.lit(False)) | F.coalesce(limitations >= 5, F.lit(False))
