"""Price-history metrics (N1-N3) and the quality and filter columns on a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans import policies as P

SNAPSHOT = ("price", "previous_close", "volume", "avg_volume_50d", "relative_volume", "change_1d", "change_5d", "change_20d", "ma20", "ma50", "high_52w", "low_52w")


def market_metrics(history: DataFrame, key: str = "ticker", date: str = "date", close: str = "close", volume: str = "volume") -> DataFrame:
    """One row a ticker.  Null closes and null volumes are dropped each before bars are counted.

    Bars are numbered once from the newest within a ticker; what is needed of the series are conditional aggregates
    over the numbers, so the only shuffle is the one that brings a ticker's bars together.
    """
    newest = Window.partitionBy(key).orderBy(F.col(date).desc(), F.col(close), F.col(volume))
    bars = history.select(key, date, X.real(close).alias("c"), X.real(volume).alias("v"))
    newest = Window.partitionBy(key).orderBy(F.col(date).desc(), F.col("c"), F.col("v"))
    bars = bars.withColumns({
        "nc": F.when(F.col("c").isNotNull(), F.count("c").over(newest.rowsBetween(Window.unboundedPreceding, 0))),
        "nv": F.when(F.col("v").isNotNull(), F.count("v").over(newest.rowsBetween(Window.unboundedPreceding, 0))),
    })
    nth = lambda n: F.max(F.when(F.col("nc") == n, F.col("c")))
    mean = lambda c, n, size: F.sum(F.when(F.col(n) <= size, F.col(c).cast("decimal(28,8)"))).cast("double") / F.count(F.when(F.col(n) <= size, 1))
    closes = F.count("c")
    m = bars.groupBy(key).agg(
        closes.alias("bars"), nth(1).alias("price"), nth(2).alias("previous_close"), nth(6).alias("c5"), nth(21).alias("c20"),
        F.max(F.when(F.col("nv") == 1, F.col("v"))).alias("volume"), mean("v", "nv", 50).alias("avg_volume_50d"),
        F.when(closes >= 20, mean("c", "nc", 20)).alias("ma20"), F.when(closes >= 50, mean("c", "nc", 50)).alias("ma50"),
        F.max("c").alias("high_52w"), F.min("c").alias("low_52w"),
    )
    change = lambda c: F.when(F.col(c) != 0, F.col("price") / F.col(c) - 1.0)
    priced = F.col("price").isNotNull()
    return m.select(
        key, "bars", *[F.when(priced, F.col(c)).alias(c) for c in ("price", "previous_close", "volume", "avg_volume_50d")],
        F.when(priced & (F.col("avg_volume_50d") != 0), F.col("volume") / F.col("avg_volume_50d")).alias("relative_volume"),
        change("previous_close").alias("change_1d"), change("c5").alias("change_5d"), change("c20").alias("change_20d"), "ma20", "ma50",
        (F.col("price") > F.col("ma20")).alias("above_ma20"), (F.col("price") > F.col("ma50")).alias("above_ma50"), "high_52w", "low_52w",
        change("high_52w").alias("distance_to_52w_high"), change("low_52w").alias("distance_to_52w_low"),
    )


def rolling_metrics(history: DataFrame, key: str = "ticker", date: str = "date", close: str = "close") -> DataFrame:
    """N2 for every date: 20- and 50-bar means (null before so many bars), 1- and 5-bar changes."""
    w = Window.partitionBy(key).orderBy(date)
    c = X.real(close)
    bars = history.where(c.isNotNull()).withColumn("c", c.cast("decimal(28,8)"))
    mean = lambda n: F.when(F.count("c").over(w.rowsBetween(1 - n, 0)) == n, F.sum("c").over(w.rowsBetween(1 - n, 0)).cast("double") / n)
    change = lambda n: F.when(F.lag(close, n).over(w) != 0, F.col(close) / F.lag(close, n).over(w) - 1.0)
    return bars.select(key, date, F.col(close).alias("close"), mean(20).alias("ma20"), mean(50).alias("ma50"), change(1).alias("change_1d"), change(5).alias("change_5d"))


def adapter_metrics(history: DataFrame, key: str = "ticker", date: str = "date", close: str = "close", volume: str = "volume") -> DataFrame:
    """One-month metrics in percent; where a bar is too far back the first one counts."""
    apart = lambda c: Window.partitionBy(key, F.isnull(c)).orderBy(F.col(date).desc(), F.col(close))
    values = history.select(key, date, close, X.real(close).alias("c"), X.real(volume).alias("v"))
    bars = values.withColumns({"n": F.when(F.col("c").isNotNull(), F.row_number().over(apart("c"))), "m": F.when(F.col("v").isNotNull(), F.row_number().over(apart("v")))})
    nth = lambda n: F.max(F.when(F.col("n") == n, F.col("c")))
    first = F.max_by("c", "n")
    m = bars.groupBy(key).agg(nth(1).alias("last"), nth(2).alias("prev"), F.coalesce(nth(6), first).alias("c5"), F.coalesce(nth(21), first).alias("c20"), F.max(F.when(F.col("m") == 1, F.col("v"))).alias("volume"), F.avg(F.when(F.col("m") <= 20, F.col("v"))).alias("a"))
    average = X.rounded(F.col("a"))
    return m.select(key, X.rounded(F.col("last"), 4).alias("regular_market_price"), X.rounded(F.col("prev"), 4).alias("previous_close"), "volume", average.alias("average_volume"), F.when(average != 0, X.rounded(F.col("volume") / average)).alias("relative_volume"),
                    *[X.percent_change(F.col(c), F.col("last")).alias(n) for c, n in (("prev", "change_1d"), ("c5", "change_5d"), ("c20", "change_20d"))])


#: Which fields weigh how much.
CRITICAL = ("ticker", "price", "previous_close", "volume", "avg_volume_50d", "market_cap")
IMPORTANT = ("relative_volume", "change_1d", "change_5d", "change_20d", "ma20", "ma50", "high_52w", "low_52w")
CONTEXT = ("company_name", "sector", "industry", "exchange", "currency")
#: Field, how it is invalid, penalty.
INVALID = (("price", "<=", 15), ("previous_close", "<=", 10), ("volume", "<", 10), ("avg_volume_50d", "<", 10), ("market_cap", "<=", 10))


def missing(c: str) -> Column:
    """Null, NaN or blank."""
    return X.is_blank(c) | F.coalesce(F.col(c).cast("string") == "NaN", F.lit(False))


def _invalid(c: str, how: str) -> Column:
    x = X.real(c)
    return F.coalesce(x <= 0 if how == "<=" else x < 0, F.lit(False))


def data_quality(df: DataFrame) -> DataFrame:
    """K4, K5: data_quality_score, data_quality_label, data_quality_issues.  Columns that are not there are missing."""
    from .stages import with_missing

    df = with_missing(df, {**dict.fromkeys((*CRITICAL, *IMPORTANT), "double"), **dict.fromkeys(("ticker", *CONTEXT), "string")})
    score = F.lit(100)
    for fields, weight in ((CRITICAL, 10), (IMPORTANT, 4), (CONTEXT, 2)):
        for c in fields:
            score = score - F.when(missing(c), weight).otherwise(0)
    for c, how, weight in INVALID:
        score = score - F.when(_invalid(c, how), weight).otherwise(0)
    issues = [F.when(missing(c), F.lit(f"missing_{k}_field:{c}")) for k, fields in (("critical", CRITICAL), ("important", IMPORTANT)) for c in fields]
    issues += [F.when(_invalid(c, how), F.lit(f"invalid_{c}")) for c, how, _ in INVALID]
    df = df.withColumn("data_quality_score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
    return df.withColumns({"data_quality_label": quality_label(F.col("data_quality_score"), 85, 60), "data_quality_issues": X.listed(*issues)})


def quality_label(score: Column, high: float, medium: float) -> Column:
    """C26."""
    return F.when(score >= high, F.lit("high")).when(score >= medium, F.lit("medium")).otherwise(F.lit("low"))


def quality_errors(df: DataFrame, key: str = "ticker", source: str = "market_data") -> DataFrame:
    """A row for each issue, with its severity."""
    issue = F.explode(X.parts("data_quality_issues", ";")).alias("issue")
    severity = F.when(F.col("issue").contains("critical") | F.col("issue").contains("invalid"), F.lit("high")).otherwise(F.lit("medium"))
    return df.select(key, issue).select(key, F.lit(source).alias("source"), "issue", severity.alias("severity"))


def basic_filters(df: DataFrame) -> DataFrame:
    """Four exclusion flags, their reasons, passes_basic_filters; no row is dropped."""
    checks = (("price", "price", P.MIN_PRICE), ("market_cap", "market_cap", P.MIN_MARKET_CAP), ("avg_volume_50d", "avg_volume_50d", P.MIN_AVG_VOLUME), ("data_quality", "data_quality_score", P.MIN_QUALITY))
    flags = {f"excluded_by_{n}": F.coalesce(X.real(c) < least, F.lit(True)) for n, c, least in checks}
    df = df.withColumns(flags)
    reasons = [F.when(F.col(f"excluded_by_{n}"), F.lit(f"{n}_below_min_or_missing:{least}")) for n, _, least in checks]
    passes = ~(F.col("excluded_by_price") | F.col("excluded_by_market_cap") | F.col("excluded_by_avg_volume_50d") | F.col("excluded_by_data_quality"))
    return df.withColumns({"filter_reasons": X.listed(*reasons), "passes_basic_filters": passes})


def quality_summary(df: DataFrame) -> DataFrame:
    """A15."""
    label = lambda v: F.count(F.when(F.col("data_quality_label") == v, 1)).alias(f"{v}_quality_rows")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), label("high"), label("medium"), label("low"), F.avg("data_quality_score").alias("avg_data_quality_score"), F.count(F.when(F.col("data_quality_issues") != "", 1)).alias("rows_with_issues"))
