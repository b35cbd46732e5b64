"""The engine's roles on the driver's tables (universe, fundamentals, prices, listings), as SQL that any engine runs.

Braces name tables; numbers with an exponent are doubles; sums of money are decimals, so their order does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One listing for each part.  Remainders of the key spread the cases that the rules ask for.
UNIVERSE = """
select p_partkey as k, case when p_partkey % 97 = 0 then ' ' else 'T' || cast(p_partkey as string) end as ticker, p_name as company_name, p_brand as sector,
       case when p_partkey % 31 = 0 then 'Insurance' else p_type end as industry,
       case p_partkey % 11 when 0 then 'OTC MARKETS' when 1 then 'NASDAQ' when 2 then 'pink' when 3 then '' when 4 then 'BMV' when 5 then 'LSE' else 'NYSE' end as exchange,
       case when p_partkey % 13 = 0 then 'etf' else 'Common_Stock' end as asset_type,
       case when p_partkey % 17 = 0 then 'no' when p_partkey % 19 = 0 then null else 'TRUE' end as is_active,
       case when p_partkey % 23 = 0 then null else p_retailprice / (1e0 + (p_partkey % 7) * 150e0) end as price,
       case when p_partkey % 53 = 0 then null else q * 1000e0 * (1 + p_partkey % 13) end as avg_volume_90d,
       case when p_partkey % 41 = 0 then null else m * (50e0 + (p_partkey % 29) * 60e0) end as market_cap,
       cast(null as double) as dollar_volume_90d, q, m
from {part} left join (select l_partkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) as q, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as m from {lineitem} group by l_partkey) s on l_partkey = p_partkey
"""

#: Fundamentals of the same listings, for Stages 2 and 3.
FUNDAMENTALS = """
select *, 30e0 + k % 71 as data_completeness_score, case when k % 29 = 0 then '' else '2024-06-30' end as financial_data_date, case when k % 59 = 0 then 'yes' else null end as special_case,
       case when k % 43 = 0 then null when k % 47 = 0 then 0e0 else m * 100e0 end as revenue_ttm,
       case when k % 37 = 0 then null else (k % 80 - 30) / 100e0 end as operating_margin, case when k % 61 = 0 then null else (k % 50 - 15) / 100e0 end as fcf_margin,
       (k % 70) / 100e0 as gross_margin, (k % 45 - 5) / 100e0 as net_margin, (k % 40 - 8) / 100e0 as revenue_growth_1y, (k % 33) / 100e0 as revenue_growth_3y,
       case when k % 67 = 0 then null else (k % 140) / 20e0 - 1e0 end as net_debt_to_ebitda, case when k % 5 = 0 then null else (k % 45) / 100e0 - 5e-2 end as shares_dilution_3y,
       (k % 30) * 1e0 as interest_coverage, (k % 25) / 10e0 as current_ratio,
       case when k % 3 = 0 then null else (k % 60) * 1e0 end as pe_ratio, case when k % 4 = 0 then null else (k % 35) * 1e0 end as ev_ebitda, case when k % 6 = 0 then null else (k % 22) * 1e0 end as price_sales,
       case when k % 7 = 0 then (k % 12) / 100e0 else null end as fcf_yield, case when k % 8 = 0 then null else (k % 65 - 22) / 100e0 end as price_change_6m,
       case when k % 9 = 0 then null else (k % 55 - 22) / 100e0 end as relative_strength_6m, case when k % 10 = 0 then null else (k % 62) / -100e0 end as drawdown_from_52w_high
from (""" + UNIVERSE + ") u where trim(ticker) <> ''"

#: A bar for each event: closes are missing for refunds, volume is the event's hour.
PRICES = """
select 'U' || cast(user_id as string) as ticker, ts as date, case when event_id % 29 = 0 then null else value end as close, case when event_id % 31 = 0 then null else cast(event_id % 997 as double) end as volume, event_id from {events}
"""

#: Market data rows as the local chain's first step leaves them.
LOCAL = """
select k as input_ordinal, ticker, company_name, company_name as name, exchange, case when k % 4 = 0 then '' else 'USA' end as country, sector, case when k % 9 = 0 then '' else industry end as industry,
       case when k % 6 = 0 then null else price end as regular_market_price, case when k % 8 = 0 then null else market_cap end as market_cap, avg_volume_90d as volume, case when k % 5 = 0 then 0e0 else (k % 40) / 10e0 end as relative_volume,
       case when k % 11 = 0 then null else (k % 41 - 20) / 100e0 end as change_1d, case when k % 12 = 0 then null else (k % 61 - 30) / 100e0 end as change_5d, case when k % 14 = 0 then null else (k % 131 - 60) / 100e0 end as change_20d,
       case k % 3 when 0 then 'METADATA_SCORE_FALLBACK' when 1 then 'MARKET_DATA_SCORE_MANUAL' else 'MARKET_DATA_SCORE_YFINANCE' end as stage3_status,
       case k % 3 when 0 then 'metadata_fallback' when 1 then 'manual_market_data.csv' else 'yfinance_cache' end as market_data_provider, case when k % 15 = 0 then 'timeout' else '' end as error
from (""" + UNIVERSE + ") u where trim(ticker) <> ''"

#: Fundamentals as given by hand: listings without a market value have none, those without a price two rows.
MANUAL_FUNDAMENTALS = """
select ticker, k + d * 1000000 as input_ordinal, m * 1e4 * (1 + k % 9) * (1 + d) as revenue, case when k % 10 = 0 then null else (k % 30 - 8) * 1e0 end as revenue_growth_yoy, case when k % 16 = 0 then null else (k % 75) * 1e0 end as gross_margin,
       (k % 55 - 12) * 1e0 as operating_margin, (k % 40 - 9) * 1e0 as net_margin, case when k % 18 = 0 then null else m * 1000e0 * (k % 21 - 5) end as free_cash_flow, m * 100e0 * (k % 6) as total_cash, case when k % 22 = 0 then null else m * 100e0 * (k % 13) end as total_debt
from (""" + UNIVERSE + ") u cross join (select 0 as d union all select 1) dd where trim(ticker) <> '' and market_cap is not null and (d = 0 or price is null)"

#: Listings of two providers over nations: suppliers are the baseline, customers the candidates.
BASELINE = "select 'N' || cast(s_nationkey % 12 as string) as exchange, 'S' || cast(s_suppkey % 90 as string) as ticker, 'ISIN' || cast(s_suppkey as string) as isin, s_name as company_name, s_suppkey as input_ordinal from {supplier}"
CANDIDATES = """
select 'N' || cast(c_nationkey % 14 as string) as exchange, 'S' || cast(c_custkey % 400 as string) as ticker, case when c_custkey % 7 = 0 then '' else 'ISIN' || cast(c_custkey % 700 as string) end as isin, c_name as company_name,
       case when c_custkey % 5 = 0 then '' else c_mktsegment end as source_provider, c_custkey as input_ordinal from {customer}
"""

#: Security names made of words the classifiers look for.
NAMES = """
select p_partkey as k, case p_partkey % 9 when 0 then 'ABCDW' when 1 then 'ABCDR' when 2 then 'ABCDU' when 3 then 'AB.PRA' else 'X' || cast(p_partkey as string) end as symbol,
       p_name || case p_partkey % 14 when 0 then ' Warrants' when 1 then ' Rights' when 2 then ' Units' when 3 then ' Preferred Stock' when 4 then ' ETF' when 5 then ' Senior Notes due 2030' when 6 then ' Acquisition Corp' when 7 then ' REIT' when 8 then ' American Depositary Shares'
                 when 9 then ' Common Stock' when 10 then ' Closed-End Fund' when 11 then ' Class A Common' else '' end as name,
       case when p_partkey % 16 = 0 then 'Y' else 'N' end as etf_flag, case when p_partkey % 20 = 0 then 'y' else '' end as test_flag from {part}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a binding over the tables in ``sf_dir``."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The binding for an engine that knows the tables by name."""
    return sql.format(**{t: t for t in TABLES})
