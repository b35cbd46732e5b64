"""Rule cascades and scores on hand-made rows, at their thresholds."""

import pytest
from pyspark.sql import functions as F

from equiscreen.functions import exprs as X
from equiscreen.operators import market, memo, reports, scoring, stages, universe, views
from equiscreen.plans import pipelines, policies

S1 = "ticker string, is_active string, asset_type string, exchange string, market_cap double, price double, avg_volume_90d double"
GOOD = ("AAA", "true", "common_stock", "NYSE", 5e8, 5.0, 1e6)


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize(
    ("change", "status", "reasons"),
    [
        ({}, "PASSED", ""), ({"ticker": " "}, "REJECTED", "MISSING_TICKER"), ({"is_active": None}, "PASSED", ""), ({"is_active": "no"}, "REJECTED", "INACTIVE_SECURITY"),
        ({"asset_type": None}, "REJECTED", "NOT_COMMON_STOCK"), ({"exchange": "pink"}, "REJECTED", "OTC_NOT_ALLOWED|EXCHANGE_NOT_IN_ALLOWED_LIST"), ({"exchange": ""}, "WATCHLIST", "MISSING_EXCHANGE"),
        ({"market_cap": float("nan")}, "REJECTED", "MISSING_MARKET_CAP"), ({"market_cap": 149_999_999.0}, "REJECTED", "MARKET_CAP_BELOW_MINIMUM"), ({"market_cap": 150e6}, "WATCHLIST", "MARKET_CAP_WATCHLIST_RANGE"),
        ({"price": 1.5, "avg_volume_90d": 1e7}, "WATCHLIST", "PRICE_STRONG_WATCHLIST_RANGE"), ({"price": 3.0, "avg_volume_90d": 1e7}, "PASSED", "PRICE_WEAK_WATCHLIST_RANGE"),
        ({"avg_volume_90d": None}, "REJECTED", "MISSING_DOLLAR_VOLUME"), ({"avg_volume_90d": 2e5}, "WATCHLIST", "DOLLAR_VOLUME_WATCHLIST_RANGE"),
    ],
)
def test_stage1(spark, change, status, reasons):
    names = [c.split()[0] for c in S1.split(", ")]
    row = one(stages.stage1(spark.createDataFrame([tuple((dict(zip(names, GOOD, strict=True)) | change).values())], S1)))
    assert (row["stage1_status"], row["stage1_all_reasons"]) == (status, reasons)
    assert row["stage1_primary_reason"] == reasons.split("|")[0]


def test_stage2_exceptions(spark):
    df = spark.sql("select 'A' as ticker, 80e0 as data_completeness_score, '2024' as financial_data_date, 10e0 as revenue_ttm, -3e-1 as operating_margin, 1e-1 as fcf_margin, 1e0 as net_debt_to_ebitda, cast(null as double) as shares_dilution_3y, 3e-1 as revenue_growth_3y, 5e-1 as gross_margin")
    row = one(stages.stage2(df))
    assert row["stage2_status"] == "WATCHLIST" and row["stage2_all_reasons"] == "OPERATING_MARGIN_TOO_NEGATIVE_BUT_RECOVERABLE|MISSING_SHARES_DILUTION_PROVIDER_LIMITATION"
    assert one(stages.stage2(df.withColumn("gross_margin", F.lit(0.1))))["stage2_status"] == "REJECTED"
    assert one(stages.stage2(df.withColumn("operating_margin", F.lit(0.1)), policies.STAGE2_EARLIER))["stage2_status"] == "WATCHLIST"


def test_stage3_scales_and_missing(spark):
    row = one(stages.stage3(spark.sql("select 'A' as ticker, 7e-1 as gross_margin, 35e-2 as operating_margin, 3e-1 as net_margin, 3e-1 as fcf_margin, 100e0 as data_completeness_score")))
    assert row["business_quality_score"] == 10.0 and row["valuation_score"] == 4.5 and row["momentum_score"] == 5.0
    assert row["financial_health_score"] == 0.0, "missing is 0 on the inverse scale too"


GOLD = {"AAPL": (97.9, 95.75, 77.74, 90.80), "MSFT": (97.8, 95.75, 99.6, None), "ASML": (97.7, 95.75, 80.41, None)}


@pytest.fixture(scope="module")
def chain(spark):
    universe_ = spark.createDataFrame([(1, "AAPL", "Apple Inc", "NASDAQ", "USA", "Technology", "Consumer Electronics"), (2, "MSFT", "Microsoft", "NASDAQ", "USA", "Technology", "Software"), (3, "ASML", "ASML", "NASDAQ", "NETHERLANDS", "Technology", "Semiconductors")], "input_ordinal long, ticker string, name string, exchange string, country string, sector string, industry string")
    manual = spark.createDataFrame([(1, "AAPL", 195.0, 3e12, 5e7, 5.5e7, 0.5, 1.2, 3.5), (2, "MSFT", 430.0, 3.2e12, 2.5e7, 2.8e7, 0.3, 0.9, 2.8), (3, "ASML", 750.0, 3e11, 1.2e6, 1.5e6, -0.2, 1.5, 4.1)], "input_ordinal long, ticker string, price double, market_cap double, volume double, average_volume double, change_1d_pct double, change_5d_pct double, change_20d_pct double")
    cache = spark.createDataFrame([], "input_ordinal long, ticker string, regular_market_price double, market_cap double, volume double, average_volume double, relative_volume double, change_1d double, change_5d double, change_20d double")
    return universe_, manual, cache


def test_local_chain_golden(spark, chain):
    merged = scoring.provider_fallback(*chain).withColumn("company_name", F.col("name"))
    rows = {r["ticker"]: r for r in scoring.local_score(merged).collect()}
    for t, (fallback, local, _, _) in GOLD.items():
        assert (rows[t]["fallback_score"], rows[t]["local_score_v0"]) == (fallback, local)


def test_explain_defaults(spark, chain):
    merged = scoring.provider_fallback(*chain, blocked=True).withColumn("company_name", F.col("name"))
    row = one(scoring.explain(scoring.local_score(merged)))
    assert row["stage3_status"] == "METADATA_SCORE_FALLBACK" and "fallback" in row["explainability_badges"] and row["positive_factors"] == "sin fortalezas destacadas"


def test_market_metrics_need_bars(spark):
    rows = [("A", i, float(i + 1), 100.0) for i in range(21)] + [("B", 0, 5.0, None), ("B", 1, None, 7.0), ("C", 0, None, None)]
    got = {r["ticker"]: r for r in market.market_metrics(spark.createDataFrame(rows, "ticker string, date int, close double, volume double")).collect()}
    assert got["A"]["change_20d"] == 21.0 / 1.0 - 1 and got["A"]["ma20"] == sum(range(2, 22)) / 20 and got["A"]["ma50"] is None
    assert got["B"]["price"] == 5.0 and got["B"]["previous_close"] is None and got["B"]["volume"] == 7.0
    assert got["C"]["price"] is None and got["C"]["relative_volume"] is None


def test_priority_excludes(spark):
    snap = market.basic_filters(market.data_quality(spark.sql("select 'A' as ticker, 1e0 as price, 2e8 as market_cap, 1e6 as avg_volume_50d, true as above_ma20, true as above_ma50, -1e-2 as distance_to_52w_high")))
    row = one(scoring.priority(snap))
    assert row["category_final"] == "excluded" and row["veto_applied"] and row["score_context"] == 100.0 and "volume" in row["missing_key_data_quant"].split(";")


def test_greedy_two_keys_equals_loop(spark):
    import random

    random.seed(3)
    rows = [(i, f"I{random.randrange(25)}", f"T{random.randrange(25)}") for i in range(120)]
    got = {r["input_ordinal"]: r["accepted"] for r in universe.greedy_two_keys(spark.createDataFrame(rows, "input_ordinal long, isin string, ticker string"), "isin", "ticker").collect()}
    a, b = set(), set()
    for i, x, y in rows:
        ok = x not in a and y not in b
        assert got[i] == ok
        if ok:
            a.add(x), b.add(y)


def test_instrument_words(spark):
    df = spark.createDataFrame([("ABC", "Netflix Common Stock"), ("ABCDW", "Plain Co"), ("ABC", "Some Acquisition Corp"), ("ABC", "X Ordinary Shares")], "symbol string, name string")
    assert [r["instrument_type"] for r in universe.instrument_class(df).collect()] == ["ETF", "WARRANT", "SPAC_OR_BLANK_CHECK", "COMMON_STOCK"]
    assert universe.instrument_class(df, strict=True).first()["instrument_type"] == "COMMON_STOCK"


def test_jpx_and_cboe(spark):
    base = spark.createDataFrame([("JPX", "2", "X2"), ("N", "BB", "I9")], "exchange string, ticker string, isin string")
    jpx = spark.createDataFrame([(1, "1.0", "A", "Prime Market (Domestic)", ""), (2, "1", "B", "Prime Market (Domestic)", ""), (3, "2", "C", "Prime Market (Domestic)", ""), (4, "3", "D ETF", "Growth Market (Domestic)", ""), (5, "4", "E", "ETFs/ETNs", ""), (6, "", "F", "", "")], "input_ordinal long, local_code string, company_name string, market_segment string, industry string")
    got = {r["input_ordinal"]: r["exclusion_reason"] for r in universe.jpx_decisions(jpx, base).collect()}
    assert got == {1: "", 2: "DUPLICATE_LOCAL_CODE_IN_JPX_SOURCE", 3: "OVERLAP_BASELINE_EXCHANGE_TICKER", 4: "NON_COMMON_EQUITY_REVIEW_EXCLUDED", 5: "ETF_ETN_MARKET_SEGMENT_EXCLUDED", 6: "BLANK_LOCAL_CODE"}
    cboe = spark.createDataFrame([(1, "AA", "A", "I1", "f"), (2, "AA", "A", "I1", "t"), (3, "AA", "A", "I2", "t"), (4, "BB", "A", "I3", "t"), (5, "CC", "A", "I9", "t")], "input_ordinal long, bats_name string, company_name string, isin string, live string")
    got = {r["input_ordinal"]: r["exclusion_reason"] for r in universe.cboe_europe_decisions(cboe, base).collect()}
    assert got == {1: "NOT_LIVE", 2: "", 3: "DUPLICATE_CBOE_BATS_NAME", 4: "BASELINE_TICKER_ALREADY_PRESENT", 5: "BASELINE_ISIN_ALREADY_PRESENT"}


def test_scalars(spark):
    df = spark.createDataFrame([("($1,200K)", "35%", "1d"), ("2.5B", "35", "1_000"), (" ", "1.2", "7")], "a string, b string, c string")
    rows = df.select(X.money("a").alias("a"), X.percent_or_ratio("b").alias("b"), X.number("c").alias("c")).collect()
    assert [tuple(r) for r in rows] == [(-1.2e6, 0.35, None), (2.5e9, 0.35, None), (None, 1.2, 7.0)]
    v = spark.sql("select 25e-1 as x").select(X.compact_usd(F.lit(1.5e9)).alias("a"), X.percent_text(F.lit(0.1234)).alias("b"), X.rounded(F.lit(2.675)).alias("c"), X.scale10(F.lit(None).cast("double"), 0, 1).alias("d")).first()
    assert tuple(v) == ("$1.50B", "12.34%", 2.68, 0.0)


def test_memo_and_flags(spark):
    row = one(pipelines.memos(spark.sql("select 'A' as ticker, 30e0 as revenue_growth, 6e0 as net_debt_to_ebitda, 'LOW FCF_MARGIN' as note"), ["note"]))
    assert row["financial_health_score"] == 90.0 and row["financial_health_status"] == "data_insufficient" and row["memo_status"] == "data_insufficient"
    assert [f["code"] for f in row["red_flags"]] == ["DEBT_NET_DEBT_EBITDA_GT_5", "FCF_REASON_PRESENT"] and row["enforced_verdict"] == "NEEDS_MORE_DATA"


def test_reports(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, None), ("b", 2.0)], "k string, x double")
    assert [tuple(r) for r in reports.value_counts(df, "k", missing="MISSING").collect()] == [("a", 2), ("MISSING", 1), ("b", 1)]
    assert tuple(reports.numeric_profile(df, ["x"]).first()) == ("x", 3, 1.0, 1.5, 2.0, 2.5, 3.0, 2.0)
    assert tuple(reports.duplicate_summary(df, "k").first()) == (1, 1, 2)


def test_views(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 2, 30), ("b", 1, 5)], "k string, t int, v int")
    assert {tuple(r) for r in views.latest(df, ["k"], "t", ties=True).collect()} == {("a", 2, 20), ("a", 2, 30), ("b", 1, 5)}
    assert {r["k"]: r["delta"] for r in views.first_last(df, "k", "v", "v").collect()} == {"a": 20, "b": None}
    got = views.resolve(df.withColumnRenamed("k", "Ticker Symbol"), {"ticker": ["symbol"], "none": ["zzz"]}, fuzzy=True)
    assert got.columns == ["ticker", "none"] and got.where("ticker = 'a'").count() == 3


def test_xetra_cascade_and_greedy_keys_equal_the_loop(spark):
    import random

    from equiscreen.operators import universe

    r = random.Random(4)
    rows = [(i, r.choice(["CS", "CS", "CS", "cs ", "ETF", ""]), r.choice(["", *(f"I{k}" for k in range(25))]), r.choice(["", *(f"T{k}" for k in range(25))])) for i in range(300)]
    base = [("XETR", f"T{k}", f"I{30 + k}") for k in range(4)] + [("LSE", "T9", "I1")]
    isins, keys, seen_i, seen_k, want = {b[2] for b in base}, {f"{b[0]}|{b[1]}" for b in base}, set(), set(), {}
    for i, kind, isin, ticker in rows:
        kind, key = kind.strip().upper(), f"XETR|{ticker}"
        if kind != "CS":
            want[i] = f"excluded_non_common_equity_instrument_type_{kind or 'blank'}"
        elif not isin or not ticker:
            want[i] = "missing_isin" if not isin else "missing_ticker"
        elif isin in isins or key in keys:
            want[i] = "already_in_baseline_by_isin" if isin in isins else "already_in_baseline_by_exchange_ticker"
        elif isin in seen_i or key in seen_k:
            want[i] = "duplicate_within_xetra_by_isin" if isin in seen_i else "duplicate_within_xetra_by_exchange_ticker"
        else:
            want[i] = ""
            seen_i.add(isin)
            seen_k.add(key)
    df = spark.createDataFrame(rows, "input_ordinal long, instrument_type string, isin string, ticker string")
    got = universe.xetra_decisions(df, spark.createDataFrame(base, "exchange string, ticker string, isin string"))
    assert {x["input_ordinal"]: x["exclusion_reason"] for x in got.collect()} == want
